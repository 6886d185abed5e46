"""Queries over documents and conversations as drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import drafts as D
from ..sources.tables import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


_REPORT = (
    "doc_id n_words n_sentences n_syllables n_complex n_letters people_words people_sentences reading_ease grade smog coleman_liau ari human_interest minutes ease_label grade_label"
).split()


def readability(spark, sf_dir):
    return D.readability(D.text_counts(_documents(spark, sf_dir))).select(_REPORT)


def draft_scores(spark, sf_dir):
    out = D.score_drafts(_documents(spark, sf_dir), "doc_id", "blog")
    return out.withColumns({c: F.array_join(c, "; ") for c in ("corporate_hits", "passive_hits", "hints")})


def top_complex_words(spark, sf_dir):
    return D.top_complex(_documents(spark, sf_dir), "doc_id")


def long_sentences(spark, sf_dir):
    return D.long_sentences(_documents(spark, sf_dir), "doc_id")


def style_hits(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", F.array_join(D.phrase_list(text), "; ").alias("corporate_hits"), F.array_join(D.passive_list(text), "; ").alias("passive_hits"))


def claim_coverage(spark, sf_dir):
    return D.coverage(_documents(spark, sf_dir), "doc_id", "packet")


def _turns(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text")


def claim_findings(spark, sf_dir):
    """Blockers and warnings of the stricter rule set over conversations."""
    found = D.findings(D.coverage(_turns(spark, sf_dir), "turn_id", "verifier"))
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.sum("n_hits").alias("n_hits"))


def claim_verdicts(spark, sf_dir):
    """A verdict for each turn, over all its rows."""
    out = D.verdict(D.coverage(_turns(spark, sf_dir), "turn_id", "verifier"), "turn_id")
    return out.withColumn("priorities", F.array_join("priorities", "; "))


def raw_contacts(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("id"), "text")
    return D.raw_contacts(docs.unionByName(turns), "id")


def phone_numbers(spark, sf_dir):
    """Canonical phone digits of documents, most frequent first."""
    hits = D.raw_contacts(_documents(spark, sf_dir), "doc_id").where("code = 'phone'")
    return hits.groupBy(X.phone_key(F.col("evidence")).alias("phone")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


QUERIES = {f.__name__: f for f in (readability, draft_scores, top_complex_words, long_sentences, style_hits, claim_coverage, claim_findings, claim_verdicts, raw_contacts, phone_numbers)}

_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: ", ".join(map(_q, xs))
_CONTRACTED = "CASE " + " ".join(f"WHEN w IN ({_list([c for c, p in X.CONTRACTIONS.items() if p == person])}) THEN '{person}'" for person in sorted(set(X.CONTRACTIONS.values()))) + " ELSE w END"
_WORDS = "list_transform(regexp_extract_all(lower({}), '[a-z]+(?:''[a-z]+)?'), lambda w: " + _CONTRACTED + ")"
_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_SENTENCES = rf"list_filter(string_split(regexp_replace({_TRIM}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[A-Za-z0-9]'))"
_BARE = "regexp_replace(w, '[^a-z]', '', 'g')"
_SYLLABLES = (
    "CASE " + " ".join(f"WHEN w = '{w}' THEN {n}" for w, n in X.SYLLABLE_EXCEPTIONS.items()) + rf" WHEN {_BARE} = '' THEN 0 "
    rf"ELSE greatest(1, len(regexp_extract_all(regexp_replace({_BARE}, 'e$', ''), '[aeiouy]+')) + CASE WHEN regexp_matches({_BARE}, '[^aeiouy]le$') THEN 1 ELSE 0 END) END"
)
_LABEL = lambda col, op, pairs, last: "CASE " + " ".join(f"WHEN {col} {op} {n} THEN {_q(x)}" for n, x in pairs) + f" ELSE {_q(last)} END"
_EASE = _LABEL("reading_ease", ">=", [(90, "Very Easy"), (80, "Easy"), (70, "Fairly Easy"), (60, "Standard"), (50, "Fairly Difficult"), (30, "Difficult")], "Very Difficult")
_GRADE = _LABEL("grade", "<=", [(5, "5th grade or below"), (6, "6th grade"), (7, "7th grade"), (9, "8th-9th grade"), (12, "10th-12th grade"), (16, "College"), (18, "College graduate")], "Professional/academic")
_PEOPLE = _list(X.PEOPLE_WORDS)
_WC = r"[\p{L}\p{N}_]"
_B = rf"(?:^|[^\p{{L}}\p{{N}}_])"

ORACLE_SQL = {
    "readability": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS ws, {_SENTENCES} AS ss FROM documents),
c AS (SELECT doc_id, len(ws)::INT AS n_words, len(ss)::INT AS n_sentences,
  list_sum(list_transform(ws, lambda w: {_SYLLABLES}))::INT AS n_syllables,
  len(list_filter(ws, lambda w: ({_SYLLABLES}) >= 3))::INT AS n_complex,
  list_sum(list_transform(ws, lambda w: length(replace(w, '''', ''))))::INT AS n_letters,
  len(list_filter(ws, lambda w: w IN ({_PEOPLE})))::INT AS people_words,
  len(list_filter(ss, lambda s: len(list_filter({_WORDS.format('s')}, lambda p: p IN ({_PEOPLE}))) > 0))::INT AS people_sentences
  FROM d WHERE len(ws) > 0 AND len(ss) > 0),
r AS (SELECT *, n_words::DOUBLE / n_sentences::DOUBLE AS per, n_syllables::DOUBLE / n_words::DOUBLE AS syl, n_letters / n_words::DOUBLE AS letters FROM c),
s AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * per - 84.6::DOUBLE * syl AS reading_ease, 0.39::DOUBLE * per + 11.8::DOUBLE * syl - 15.59::DOUBLE AS grade FROM r)
SELECT doc_id, n_words, n_sentences, n_syllables, n_complex, n_letters, people_words, people_sentences, reading_ease, grade,
  1.043::DOUBLE * sqrt(n_complex * (30 / n_sentences::DOUBLE)) + 3.1291::DOUBLE AS smog,
  0.0588::DOUBLE * (letters * 100) - 0.296::DOUBLE * (n_sentences::DOUBLE / n_words::DOUBLE * 100) - 15.8::DOUBLE AS coleman_liau,
  4.71::DOUBLE * letters + 0.5::DOUBLE * per - 21.43::DOUBLE AS ari,
  3.635::DOUBLE * (people_words / n_words::DOUBLE * 100) + 0.314::DOUBLE * (people_sentences / n_sentences::DOUBLE * 100) AS human_interest,
  greatest(1, round_even(n_words / 200.0::DOUBLE, 0))::INT AS minutes, {_EASE} AS ease_label, {_GRADE} AS grade_label FROM s""",
    "top_complex_words": f"""
WITH e AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents),
c AS (SELECT doc_id, w AS word, count(*) AS n FROM e WHERE ({_SYLLABLES}) >= 3 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rk FROM c)
SELECT doc_id, rk::INT AS rank, word, n FROM r WHERE rk <= 12""",
    "long_sentences": f"""
WITH d AS (SELECT doc_id, {_SENTENCES} AS ss FROM documents),
e AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(1, len(ss) + 1)) AS ord FROM d),
l AS (SELECT doc_id, ord::INT AS ord, sentence, len(regexp_extract_all(lower(sentence), '[a-z]+(?:''[a-z]+)?'))::INT AS n_words FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INT AS rank FROM l WHERE n_words >= 23)
SELECT doc_id, rank, ord, n_words, sentence FROM r WHERE rank <= 8""",
    "style_hits": "SELECT doc_id, array_to_string(list_sort(list_filter(["
    + ", ".join(rf"CASE WHEN regexp_matches(text, '(?i){_B}{p}(?:$|[^\p{{L}}\p{{N}}_])') THEN {_q(p)} END" for p in D.CORPORATE_PHRASES)
    + "], lambda x: x IS NOT NULL)), '; ') AS corporate_hits, array_to_string(list_slice(flatten(["
    + ", ".join(rf"regexp_extract_all(text, '(?i){_B}({p[2:-2].replace(chr(92) + 'w', _WC).replace('(is', '(?:is').replace('(can', '(?:can')})\b', 1)" for p in D.PASSIVE_PATTERNS)
    + "]), 1, 8), '; ') AS passive_hits FROM documents",
    "raw_contacts": rf"""
WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || ':' || turn, text FROM conversations),
e AS (SELECT id, 'email' AS code, regexp_extract_all(text, {_q(X.EMAIL)}) AS f FROM t UNION ALL SELECT id, 'phone', regexp_extract_all(text, {_q(X.PHONE)}) FROM t)
SELECT id, code, unnest(range(0, len(f)))::INT AS ord, unnest(f) AS evidence FROM e""",
    "phone_numbers": rf"""
WITH e AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, {_q(X.PHONE)})), '[^0-9]', '', 'g') AS p FROM documents)
SELECT CASE WHEN length(p) = 11 THEN regexp_replace(p, '^1', '') ELSE p END AS phone, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM e GROUP BY 1""",
}


def _count(pattern: str, of: str = "text") -> str:
    return f"len(regexp_extract_all({of}, {_q('(?i)' + pattern)}))"


def _loose(pattern: str, qualifier: str) -> str:
    return rf"coalesce(list_sum(list_transform(list_filter(string_split_regex(text, '[.!?\n]'), lambda s: NOT regexp_matches(s, {_q('(?i)' + qualifier)})), lambda s: {_count(pattern, 's')})), 0)"


def _stated(pattern: str) -> str:
    """Matches of a rule whose clause before them does not deny them: matches of clause and rule together, less denied ones."""
    found = f"regexp_extract_all(text, {_q('(?i)' + pattern)})"
    clause = rf"regexp_extract(x, '(?s)([^.!?;\n]*)$', 1)"
    last = rf"list_last(string_split_regex(lower({clause}), '\b(?:but|however)\b'))"
    denied = rf"regexp_matches({last}, '\bno\b|\bnot\b|\bnever\b|\bwithout\b|\bdo(?:es)?\s+not\s+promise\b|\bdoesn''t\s+promise\b')"
    # the text before each match: pieces between matches, with the matches before put back
    before = rf"list_transform(range(1, len({found}) + 1), lambda i: array_to_string(list_transform(range(1, i + 1), lambda j: list_extract(string_split_regex(text, {_q('(?i)' + pattern)}), j) || CASE WHEN j < i THEN list_extract({found}, j) ELSE '' END), ''))"
    return f"CASE WHEN regexp_matches(text, {_q('(?i)' + pattern)}) THEN len(list_filter({before}, lambda x: NOT {denied})) ELSE 0 END"


def _coverage_sql(rule_set: str, table: str, key: str) -> str:
    packet = rule_set == "packet"
    bad, unsure = ("fail", "unresolved") if packet else ("blocker", "warning")
    group = lambda g: " + ".join(_stated(p) for gg, _, p in D.RULES[rule_set] if gg == g) or "0"
    claim = lambda g: f"CASE WHEN {g} > 0 THEN '{bad}' ELSE '{unsure}' END"
    rows = [
        ("RA-NO-GUARANTEED-OUTCOMES", claim("outcomes"), "outcomes"),
        ("RA-NO-AUTO-PUBLISHING", claim("automation"), "automation"),
        ("RA-NO-REPLACING-AGENTS", claim("replacing"), "replacing"),
        ("RA-NO-RAW-CONTACT-DATA", f"CASE WHEN contacts > 0 THEN '{bad}' ELSE 'pass' END", "contacts"),
        ("RA-ANSWER-EVIDENCE-QUALIFIER", f"CASE WHEN loose_answers > 0 THEN '{unsure}' WHEN answers THEN 'pass' ELSE 'not_applicable' END", "loose_answers"),
        ("RA-OWNERSHIP-QUALIFIER", f"CASE WHEN loose_owners > 0 THEN '{unsure}' ELSE 'not_applicable' END", "loose_owners"),
        ("RA-HONEST-CTA", f"'{unsure}'", "0"),
    ]
    if not packet:
        rows += [("RA-NO-PRIVACY-CHURN-CLAIMS", claim("privacy_churn"), "privacy_churn"), ("RA-OWNER-ROUTING-COVERAGE", f"CASE WHEN shape THEN '{unsure}' ELSE 'not_applicable' END", "0")]
    # SQL's regular expressions have no look-ahead: the word after "resolution" is matched and taken away
    answers = (lambda of: _count(D.ANSWER["packet"], of)) if packet else (lambda of: rf"(len(regexp_extract_all({of}, '(?i)\b(?:drafted answer|answer|answers)\b|\bresolutions?\b')) - len(regexp_extract_all({of}, '(?i)\bresolutions?\s+(?:audit|snapshot)\b')))")
    loose = rf"coalesce(list_sum(list_transform(list_filter(string_split_regex(text, '[.!?\n]'), lambda s: NOT regexp_matches(s, {_q('(?i)' + D.ANSWER_QUALIFIER)})), lambda s: {answers('s')})), 0)"
    facts = f"""SELECT {key} AS k, {', '.join(f'{group(g)} AS {g}' for g in ('outcomes', 'automation', 'replacing', 'privacy_churn'))},
 len(regexp_extract_all(text, {_q(X.EMAIL)})) + len(regexp_extract_all(text, {_q(X.PHONE)})) AS contacts, {answers('text')} > 0 AS answers, regexp_matches(text, {_q('(?i)' + D.REPORT_SHAPE)}) AS shape,
 {loose} AS loose_answers, {_loose(D.OWNERSHIP, D.OWNERSHIP_QUALIFIER)} AS loose_owners FROM {table}"""
    return f"WITH f AS ({facts}), v AS (" + " UNION ALL ".join(f"SELECT k, '{r}' AS rule_id, {s} AS status, ({n})::BIGINT AS n_hits FROM f" for r, s, n in rows) + ") "


_TURNS = _coverage_sql("verifier", "conversations", "conv_id || ':' || turn")
ORACLE_SQL["claim_coverage"] = _coverage_sql("packet", "documents", "doc_id") + "SELECT k AS doc_id, rule_id, status, n_hits FROM v"
ORACLE_SQL["claim_findings"] = _TURNS + "SELECT rule_id, status AS severity, count(*) AS n, sum(n_hits)::BIGINT AS n_hits FROM v WHERE status IN ('blocker', 'warning') GROUP BY 1, 2"
ORACLE_SQL["claim_verdicts"] = (
    _TURNS
    + """, b AS (SELECT k, bool_or(status = 'blocker') AS blocked, bool_or(status = 'warning') AS warned, bool_or(rule_id = 'RA-OWNER-ROUTING-COVERAGE' AND status = 'warning') AS w1,
 bool_or(rule_id = 'RA-ANSWER-EVIDENCE-QUALIFIER' AND status = 'warning') AS w2, bool_or(rule_id = 'RA-OWNERSHIP-QUALIFIER' AND status = 'warning') AS w3 FROM v GROUP BY 1)
SELECT k AS turn_id, CASE WHEN blocked THEN 'Do not post yet' WHEN warned THEN 'Needs human review' ELSE 'No obvious blockers' END AS verdict, NOT blocked AND NOT warned AS passed,
 concat_ws('; ', CASE WHEN blocked THEN 'Remove blocker language before posting.' END, CASE WHEN w1 THEN 'Add the probable owner lane if this draft explains the report or Snapshot.' END,
  CASE WHEN w2 THEN 'Qualify answer/draft claims with evidence language or no-proven-answer wording.' END, CASE WHEN w3 THEN 'Replace certain ownership with probable, may, appears, route, or investigate language.' END) AS priorities FROM b"""
)
