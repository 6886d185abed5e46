"""Queries that audit pages, documents and line items as generated bodies against contracts derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import evidence as E
from ..operators import pages as P
from ..sources import dom
from ..sources.tables import read_table

_WORDS = ["the", "of", "und", "der", "les", "de", "la"]


def _pages(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def _nodes(spark, sf_dir) -> DataFrame:
    return dom.explode_dom(_pages(spark, sf_dir))


def _exposed(spark, sf_dir) -> DataFrame:
    """Documents as exposed texts of a page each."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.lit("visual").alias("surface"), "text")


def answer_frames(spark, sf_dir):
    """Answers that were cut off or do not frame a body: pages as answers, some fenced, some without a body."""
    k = F.col("page_id")
    body = F.regexp_extract("html", "(?s)<body>.*</body>", 0)
    html = F.when(k % 5 == 0, F.concat(F.lit("```html\n"), body, F.lit("\n```"))).when(k % 5 == 1, F.concat(body, F.lit(" tail"))).when(k % 5 == 2, "html").otherwise(body)
    raw = F.when(k % 7 == 0, " ").otherwise(F.col("html"))
    bodies = _pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.when(k % 11 == 0, "length").when(k % 2 == 0, "stop").alias("finish_reason"), html.alias("body"), raw.alias("html"))
    return A.check_complete(bodies).unionByName(A.check_frame(bodies.select("doc_id", A.strip_fence(F.col("body")).alias("html"))))


def forbidden_markup(spark, sf_dir):
    """Forbidden elements and comments that leak a marker."""
    nodes = _nodes(spark, sf_dir)
    return A.check_forbidden(nodes).unionByName(A.check_comments(nodes, ["ad", "no such"]))


def class_audit(spark, sf_dir):
    """Classes outside a catalog or forbidden, counts and child sequences that differ."""
    nodes, k = _nodes(spark, sf_dir), F.col("page_id")
    spare = _pages(spark, sf_dir).where("page_id % 4 = 0").select(F.lit("card").alias("class")).distinct()
    forbidden = spare.select(F.lit("ad").alias("class"))
    counts = _pages(spark, sf_dir).select(k.alias("doc_id"), F.lit("ad").alias("class"), (k % 2 + 1).cast("int").alias("n"))
    children = _pages(spark, sf_dir).select(k.alias("doc_id"), F.lit("ad").alias("class"), F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("children"))
    return A.check_class_catalog(nodes, spare, forbidden).unionByName(A.check_class_counts(nodes, counts)).unionByName(A.check_child_sequence(nodes, children))


def class_texts(spark, sf_dir):
    """Pages whose texts of a class are not the list in their markup, for some with a word more."""
    k = F.col("page_id")
    own = F.trim(F.regexp_replace(F.regexp_extract("html", '<div class="ad">([^<]*)</div>', 1), r"\s+", " "))
    required = _pages(spark, sf_dir).where(~F.col("html").rlike('<div class="ad">[^<]*&')).select(k.alias("doc_id"), F.array(F.when(k % 6 == 0, F.concat(own, F.lit(" more"))).otherwise(own)).alias("values"))
    return A.check_class_text(_nodes(spark, sf_dir), "ad", required)


def action_audit(spark, sf_dir):
    """Link destinations outside those of even-numbered links, and pages without their one form."""
    nodes = _nodes(spark, sf_dir)
    links = P.links(nodes)
    contract = links.where("ord % 2 = 0").select(F.col("page_id").alias("doc_id"), F.lit("action").alias("kind"), F.col("href").alias("value"))
    forms = _pages(spark, sf_dir).where("page_id % 3 = 0").select(F.col("page_id").alias("doc_id"), F.lit("form_action").alias("kind"), F.lit("/send").alias("value"))
    return A.check_actions(links, contract).unionByName(A.check_form(nodes, forms))


def contact_audit(spark, sf_dir):
    """E-mails outside a contract of those of even lengths, and all phones and addresses, of documents."""
    seen = _exposed(spark, sf_dir)
    mails = seen.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.EMAIL), 0)).alias("value"))
    contract = mails.where(F.length("value") % 2 == 0).select("doc_id", F.lit("email").alias("kind"), "value")
    return A.check_contacts(seen, contract)


def phrase_audit(spark, sf_dir):
    """Forbidden phrases and placeholders of documents, run together or not."""
    seen = _exposed(spark, sf_dir)
    marked = seen.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 9 == 0, " {{name}} [CITY] [x]").otherwise("")))
    tokens = seen.where("doc_id % 9 = 0").select(F.lit("[CITY]").alias("token")).distinct()
    return A.check_forbidden_phrases(seen, ["of the", "der und", "de la"]).unionByName(A.check_placeholders(marked, tokens))


def required_copy(spark, sf_dir):
    """Values that no turn of a conversation holds, and turns outside a catalog of the user's own."""
    turns = read_table(spark, sf_dir, "conversations").where("text is not null")
    seen = turns.select(F.col("conv_id").alias("doc_id"), F.lit("visual").alias("surface"), "text")
    some = turns.select(F.col("conv_id").alias("doc_id")).distinct()
    required = some.select("doc_id", F.explode(F.array(*map(F.lit, _WORDS))).alias("value"))
    catalog = turns.where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("value"))
    copy = A.check_visible_copy(seen, catalog).select("doc_id", "rule_id", F.md5("evidence").alias("evidence"))
    return A.check_required_values(seen, required).unionByName(copy)


def review_audit(spark, sf_dir):
    """Line items as review cards without a source review of their own; sources are the discounted ones."""
    cards = _items(spark, sf_dir)
    out = A.check_review_cards(cards, cards.where("discount > 0.03"))
    return out.groupBy("doc_id", "rule_id", "evidence").agg(F.count("*").alias("n"))


def _items(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("author"), F.col("l_quantity").cast("int").alias("rating"), F.col("l_linestatus").alias("text"), F.col("l_discount").alias("discount"), F.lit("").alias("date"), F.lit("").alias("platform"))


def order_verdicts(spark, sf_dir):
    """Orders by their line items' flags as violations: whether admitted, the first rule in order, and how many."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_discount > 0.04")
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    return A.verdicts(docs, items.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("rule_id")), ["R", "A"])


def picked_attempts(spark, sf_dir):
    """The first admitted of a customer's first two orders, with the error of the one before."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = F.row_number().over(_by("o_custkey", "o_orderkey"))
    attempts = o.select(F.col("o_custkey").alias("doc_id"), n.alias("attempt"), (F.col("o_orderstatus") != "P").alias("admitted"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("first_rule"), F.col("o_orderkey").cast("string").alias("html"))
    return A.pick_attempt(attempts)


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


def _lines(spark, sf_dir) -> DataFrame:
    """Lines of documents, numbered from 1."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")


def channel_lines(spark, sf_dir):
    """Words of lines about licenses that are no allowed ones, by word; lines that claim, guarded and denied ones left out."""
    lines = _lines(spark, sf_dir)
    words = E.check_channel_lines(lines, ["the", "license"], ["of", "and"], r"(?i)\blicensed?\b").select("word", F.lit("word").alias("kind"))
    claims = E.check_target_claims(lines, {"license": r"\blicensed?\b", "rights": r"\brights\b"}, r"\bunless\b", r"\bnot\b").select(F.col("field").alias("word"), F.lit("claim").alias("kind"))
    passing = E.check_pass_wording(lines, ["License", "License,"], r"(?i)\blicensed\b").select(F.col("rule_id").alias("word"), F.lit("wording").alias("kind"))
    return words.unionByName(claims).unionByName(passing).groupBy("kind", "word").agg(F.count("*").alias("n"))


def logical_lines(spark, sf_dir):
    """Lengths of the logical lines of documents whose every third line is a bullet and the next one indented."""
    lines = _lines(spark, sf_dir)
    kind = F.col("line") % 3
    marked = lines.withColumn("text", F.when(kind == 0, F.concat(F.lit("- "), F.trim("text"))).when(kind == 1, F.concat(F.lit("   x"), F.trim("text"))).otherwise(F.trim("text")))
    return E.logical_lines(marked).groupBy("file").agg(F.count("*").alias("n"), F.sum(F.length("logical")).alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        answer_frames, forbidden_markup, class_audit, class_texts, action_audit, contact_audit, phrase_audit, required_copy, review_audit, order_verdicts, picked_attempts, channel_lines, logical_lines,
    )
}

_BARE = r"regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs')"
_COMPACT = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_NORM = r"lower(trim(regexp_replace(regexp_replace({}, '[\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), '^ +| +$', '', 'g')))"
_LINES = "l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL)"
_MAIL = r"(?i)[A-Z0-9._%+-]{1,64}@(?:[A-Z0-9-]{1,63}\.)+[A-Z]{2,63}"
ORACLE_SQL = {
    "answer_frames": r"""WITH b AS (SELECT page_id AS k, html, strlen(regexp_extract(html, '(?s)<body>.*</body>', 0)) AS n FROM pages)
SELECT k AS doc_id, 'complete' AS rule_id, CASE WHEN k % 11 = 0 THEN 'length' ELSE 'empty' END AS evidence FROM b WHERE k % 11 = 0 OR k % 7 = 0 OR trim(coalesce(html, '')) = ''
UNION ALL SELECT k, 'frame', CASE WHEN k % 5 = 2 OR n = 0 THEN 'begin' ELSE CASE WHEN k % 5 = 1 THEN 'end' ELSE 'size' END END FROM b WHERE k % 5 IN (1, 2) OR n = 0 OR n > 524288""",
    "forbidden_markup": rf"""WITH t AS (SELECT page_id AS doc_id, unnest(regexp_extract_all({_BARE}, '<(meta|base|link|iframe|object|embed|template|noscript)\b', 1)) AS tag FROM pages
UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<(script|style)\b', 1)) FROM pages)
SELECT doc_id, 'forbidden_tag' AS rule_id, tag AS evidence FROM t UNION ALL
SELECT page_id, 'comment_marker', 'ad' FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS c FROM pages) WHERE lower(c) LIKE '%ad%'""",
    "class_audit": """WITH c AS (SELECT page_id AS k, len(regexp_extract_all(html, 'class="ad"')) AS n FROM pages)
SELECT k AS doc_id, 'class_outside_catalog' AS rule_id, 'ad' AS evidence FROM c WHERE n > 0 UNION ALL SELECT k, 'class_forbidden', 'ad' FROM c WHERE n > 0
UNION ALL SELECT k, 'class_count', 'ad ' || n || ' of ' || (k % 2 + 1) FROM c WHERE n <> k % 2 + 1 UNION ALL SELECT k, 'child_sequence', 'ad' FROM c WHERE n > 0 AND k % 3 = 0""",
    "class_texts": """SELECT page_id AS doc_id, 'class_text' AS rule_id, 'ad' AS evidence FROM pages WHERE page_id % 6 = 0 AND NOT regexp_matches(html, '<div class="ad">[^<]*&')""",
    "action_audit": rf"""WITH l AS (SELECT page_id AS doc_id, unnest(range(1, len(h) + 1)) AS ord, replace(unnest(h), '&amp;', '&') AS href FROM (SELECT page_id, regexp_extract_all({_BARE}, '<a href="([^"]*)">', 1) AS h FROM pages))
SELECT DISTINCT doc_id, 'action_outside_source' AS rule_id, href AS evidence FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND b.href = a.href AND b.ord % 2 = 0)
UNION ALL SELECT page_id, 'form', NULL FROM pages WHERE page_id % 3 = 0""",
    # no look-around here: what stands before and after a number is read along, so phones go by text whose separators are doubled
    "contact_audit": rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS v FROM documents),
p AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '([^0-9()+])', '\1\1', 'g'), '(?:^|[^0-9])((?:\+?1[\s()./-]*)?\(?[2-9]\d{{2}}\)?[\s./-]*[2-9]\d{{2}}[\s./-]*\d{{4}})(?:$|[^0-9])', 1)), '[^0-9]', '', 'g') AS v FROM documents),
a AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b(\d{{1,7}}\s+(?:(?:n|s|e|w|north|south|east|west)\.?\s+)?(?:[\w.''-]*[A-Za-z][\w.''-]*\s+){{1,6}}(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|court|ct|highway|hwy|route|rte|parkway|pkwy|circle|cir|trail|trl|way)(?:\.\B|\b))', 1)
 || regexp_extract_all(text, '(?i)(?:^|[^\w+()./-])(\d{{1,7}}\s+(?:[A-Za-z0-9.''-]*[A-Za-z][A-Za-z0-9.''-]*\s+){{0,5}}[A-Za-z0-9.''-]*[A-Za-z][A-Za-z0-9.''-]*(?:,\s*|\s+)[A-Za-z][A-Za-z .''-]{{1,48}},?\s+[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?)(?:$|\D)', 1)) AS v FROM documents)
SELECT DISTINCT doc_id, 'email_outside_source' AS rule_id, lower(v) AS evidence FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = a.doc_id AND lower(b.v) = lower(a.v) AND length(b.v) % 2 = 0)
UNION ALL SELECT DISTINCT doc_id, 'phone_outside_source', CASE WHEN length(v) = 11 THEN regexp_replace(v, '^1', '') ELSE v END FROM p UNION ALL SELECT DISTINCT doc_id, 'address_outside_source', v FROM a""",
    "phrase_audit": "WITH d AS (SELECT doc_id, "
    + _NORM.format("text")
    + " AS n, "
    + _COMPACT.format("text")
    + """ AS c FROM documents), p AS (SELECT unnest(['of the', 'der und', 'de la']) AS p)
SELECT DISTINCT doc_id, 'forbidden_phrase' AS rule_id, p AS evidence FROM d, p WHERE contains(n, p) OR contains(c, replace(p, ' ', '')) UNION ALL
SELECT DISTINCT doc_id, 'placeholder', unnest(['{{name}}', '[CITY]']) FROM documents WHERE doc_id % 9 = 0 AND text IS NOT NULL""",
    "required_copy": rf"""WITH t AS (SELECT conv_id, role, text, ' ' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ' AS w FROM conversations WHERE text IS NOT NULL), w AS (SELECT unnest({_WORDS}) AS w)
SELECT DISTINCT conv_id AS doc_id, 'required_value' AS rule_id, w.w AS evidence FROM t a, w WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.conv_id = a.conv_id AND regexp_matches(b.w, ' ' || regexp_replace(w.w, '(.)', '\1 ?', 'g') || ' ')) UNION ALL
"""
    + """SELECT DISTINCT conv_id, 'copy_outside_catalog', md5("""
    + _NORM.format("text")
    + ") FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.conv_id = a.conv_id AND b.role = 'user' AND "
    + _NORM.format("b.text")
    + " = "
    + _NORM.format("a.text")
    + ")",
    "review_audit": """WITH c AS (SELECT l_suppkey AS doc_id, l_returnflag AS author, l_quantity::INT AS rating, l_linestatus AS text, count(*) AS n, count(*) FILTER (l_discount > 0.03) AS m FROM lineitem GROUP BY ALL)
SELECT doc_id, 'review_without_source' AS rule_id, author AS evidence, sum(n - m)::BIGINT AS n FROM c WHERE n > m GROUP BY ALL""",
    "order_verdicts": """WITH v AS (SELECT l_orderkey AS doc_id, arg_min(l_returnflag, CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN '2' ELSE '3' || l_returnflag END) AS first_rule, count(*) AS n FROM lineitem WHERE l_discount > 0.04 GROUP BY 1)
SELECT o_orderkey AS doc_id, v.doc_id IS NULL AS admitted, first_rule, coalesce(n, 0) AS n_violations FROM orders LEFT JOIN v ON v.doc_id = o_orderkey""",
    "picked_attempts": """WITH n AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderstatus <> 'P' AS ok, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS attempt FROM orders),
m AS (SELECT *, lag(CASE WHEN NOT ok THEN p END) OVER (PARTITION BY doc_id ORDER BY attempt) AS previous_error FROM n WHERE attempt <= 2), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY attempt) AS r FROM m WHERE ok)
SELECT doc_id, attempt, o_orderkey::VARCHAR AS html, previous_error FROM f WHERE r = 1""",
    "channel_lines": rf"""WITH {_LINES}, w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z-]+'))) AS word FROM l WHERE regexp_matches(text, '(?i)\blicensed?\b')),
g AS (SELECT text FROM l WHERE NOT regexp_matches(text, '(?i)\bunless\b') AND NOT regexp_matches(text, '(?i)\bnot\b')), x AS (SELECT 'word' AS kind, word FROM w WHERE word NOT IN ('the', 'license', 'of', 'and')
UNION ALL SELECT 'claim', 'license' FROM g WHERE regexp_matches(text, '(?i)\blicensed?\b') UNION ALL SELECT 'claim', 'rights' FROM g WHERE regexp_matches(text, '(?i)\brights\b')
UNION ALL SELECT 'wording', 'License' FROM l WHERE regexp_matches(text, '(?i)\blicensed\b') AND contains(text, 'License') UNION ALL SELECT 'wording', 'License,' FROM l WHERE regexp_matches(text, '(?i)\blicensed\b') AND contains(text, 'License,'))
SELECT kind, word, count(*) AS n FROM x GROUP BY ALL""",
    "logical_lines": rf"""WITH {_LINES}, m AS (SELECT file, line, CASE line % 3 WHEN 0 THEN '- ' || trim(text) WHEN 1 THEN '   x' || trim(text) ELSE trim(text) END AS t FROM l),
n AS (SELECT *, lag(t) OVER w AS b, lead(t) OVER w AS a FROM m WINDOW w AS (PARTITION BY file ORDER BY line))
SELECT file, count(*) AS n, sum(length(trim(t)) + CASE WHEN line % 3 = 1 AND regexp_matches(b, '^\s*[-*] ') THEN length(trim(b)) + 1 ELSE 0 END + CASE WHEN regexp_matches(t, '^\s*[-*] ') AND regexp_matches(a, '^\s{{2,}}\S') AND NOT regexp_matches(a, '^\s*[-*] ') THEN length(trim(a)) + 1 ELSE 0 END)::BIGINT AS n_chars FROM n GROUP BY 1""",
}
