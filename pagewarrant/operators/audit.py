"""Audit of generated pages against per-record contracts.

Pages are DOM nodes whose ``page_id`` is the document id; contracts are long
tables, a row per allowed or required value.  Every check returns violations
``doc_id, rule_id, evidence``; ``verdicts`` folds them by a rule order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import context as C
from ..functions import text as X
from ..sources.dom import VOID
from . import pages as P

MAX_BODY, MAX_DOCUMENT = 512 * 1024, 2 * 1024 * 1024
# Elements and attributes that a generated body may not hold, and shapes of claims.
FORBIDDEN_TAGS = ["applet", "base", "embed", "frame", "frameset", "iframe", "link", "meta", "noscript", "object", "script", "style", "template"]
PHONE_LIKE = r"(?<!\d)(?:\+?1[\s()./-]*)?\(?[2-9]\d{2}\)?[\s./-]*[2-9]\d{2}[\s./-]*\d{4}(?!\d)"
STREET_LIKE = (
    r"(?i)(?<!\w)\d{1,7}\s+(?:(?:n|s|e|w|north|south|east|west)\.?\s+)?(?:(?=[\w.'-]*[A-Za-z])[\w.'-]+\s+){1,6}"
    r"(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|court|ct|highway|hwy|route|rte|parkway|pkwy|circle|cir|trail|trl|way)\.?(?!\w)"
)
POSTAL_LIKE = (
    r"(?i)(?<![\w+()./-])\d{1,7}\s+(?:[A-Za-z0-9.'-]*[A-Za-z][A-Za-z0-9.'-]*\s+){0,5}[A-Za-z0-9.'-]*[A-Za-z][A-Za-z0-9.'-]*(?:,\s*|\s+)"
    r"[A-Za-z][A-Za-z .'-]{1,48},?\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?(?!\d)"
)
DIRECTIONAL = "\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069"
RADIUS = r"(?i)(?<!\d)(\d{1,4})\s*(?:-|\s)?(?:mi|mile|miles)\b"
ESTABLISHED = r"(?i)(?<!\w)(?:since|established(?:\s+in)?|founded(?:\s+in)?)\s+(\d{4})(?!\d)"
TENURES = [
    r"(?i)(?<!\w)(\d{1,3})\s*\+?\s+years?\s+of\b",
    r"(?i)(?<!\w)(?:serving|operating|trusted|in\s+business)\b[^.!?]{0,48}?\b(\d{1,3})\s*\+?\s+years?\b",
    r"(?i)(?<!\w)(?:over|more\s+than)\s+(\d{1,3})\s*\+?\s+years?\b",
    r"(?i)(?<!\w)(\d{1,3})\s*\+\s*years?\b",
    r"(?i)(?<!\w)(\d{1,3})\s*\+?\s+years?\s+(?:experience|service)\b",
]
GENERIC_TENURE = r"(?i)(?<!\w)(?:for\s+(?:many\s+)?(?:years|decades|generations?)|(?:decades|generations?)\s+of\s+(?:experience|service|work|business|craftsmanship|expertise))\b"
TESTIMONIAL_TAGS = ["blockquote", "cite"]
ATTRIBUTED = r"[.!?][\"”'‘’]?\s*[—–]\s*[A-Z][A-Za-z'.’\-]+"


def _violations(df: DataFrame, rule: str, evidence: Column, doc: str = "page_id") -> DataFrame:
    return df.select(F.col(doc).cast("long").alias("doc_id"), F.lit(rule).alias("rule_id"), evidence.cast("string").alias("evidence"))


def compact(text: Column) -> Column:
    """Letters and digits alone, lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def norm(text: Column) -> Column:
    return F.lower(X.trim_space(F.regexp_replace(text, r"(?U)\s+", " ")))


def check_complete(bodies: DataFrame) -> DataFrame:
    """Answers that were cut off or are empty: ``bodies`` has doc_id, finish_reason, html."""
    bad = F.when(F.coalesce("finish_reason", F.lit("stop")) != "stop", F.col("finish_reason")).when(F.trim(F.coalesce("html", F.lit(""))) == "", "empty")
    return _violations(bodies.withColumn("bad", bad).where("bad is not null"), "complete", F.col("bad"), "doc_id")


def strip_fence(html: Column) -> Column:
    """The body inside an outer code fence."""
    return F.regexp_replace(F.trim(html), r"(?s)^```[A-Za-z]*\s*\n(.*?)\n?```$", "$1")


def check_frame(bodies: DataFrame) -> DataFrame:
    """Bodies that do not begin and end as one, or are too large."""
    html = F.trim("html")
    bad = F.when(~html.rlike(r"(?i)^<body[\s>]"), "begin").when(~html.rlike(r"(?i)</body>$"), "end").when(F.octet_length(html) > MAX_BODY, "size")
    return _violations(bodies.withColumn("bad", bad).where("bad is not null"), "frame", F.col("bad"), "doc_id")


def check_document(documents: DataFrame) -> DataFrame:
    """Whole documents that do not begin as HTML and end it, or are too large."""
    html = F.trim("html")
    bad = F.when(~html.rlike(r"(?i)^<!doctype html\b"), "begin").when(~html.rlike(r"(?i)</html>$"), "end").when(F.octet_length(html) > MAX_DOCUMENT, "size")
    return _violations(documents.withColumn("bad", bad).where("bad is not null"), "document", F.col("bad"), "doc_id")


def tag_marks(html: Column) -> Column:
    """Tags of a text in order, as ``p``, ``/p`` or ``p/``; comments and the contents of scripts and styles are none."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "<$1></$1>")
    tags = F.regexp_extract_all(bare, F.lit(r"""</?[A-Za-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""), 0)
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1))
    return F.transform(tags, lambda t: F.concat(F.when(t.startswith("</"), "/").otherwise(""), name(t), F.when(t.endswith("/>") & ~t.startswith("</"), "/").otherwise("")))


def check_balance(bodies: DataFrame) -> DataFrame:
    """The first tag that closes nothing, another element or a void one, that closes itself, or that stays open; and bodies with other than one root.

    ``bodies`` has doc_id, html.  Open elements are one text that a fold over the tags carries, an error begins with ``!``.
    """
    void = lambda name: name.isin(sorted(VOID))

    def step(s, t):
        ends, own = F.substring(t, 2, 1_000_000), F.regexp_replace(t, "/$", "")
        last = F.substring_index(s, " ", -1)
        closed = F.when(void(ends), F.concat(F.lit("!void "), ends)).when(s == "", F.concat(F.lit("!unexpected "), ends)).when(last != ends, F.concat(F.lit("!misnested "), ends, F.lit(" in "), last)).otherwise(F.substring(s, F.lit(1), F.length(s) - F.length(ends) - 1))
        alone = F.when(void(own) | (own == "svg") | F.concat(s, F.lit(" ")).contains(" svg "), s).otherwise(F.concat(F.lit("!self_closed "), own))
        return F.when(s.startswith("!"), s).when(t.startswith("/"), closed).when(t.endswith("/"), alone).when(void(t), s).otherwise(F.concat(s, F.lit(" "), t))

    tags = bodies.select("doc_id", tag_marks(F.col("html")).alias("tags"))
    of = lambda mark: F.size(F.filter("tags", lambda t: t == mark))
    state = F.aggregate(F.filter("tags", lambda t: ~t.isin("body", "/body")), F.lit(""), step)
    error = F.when(F.col("state").startswith("!"), F.substring("state", 2, 1_000_000)).when(F.col("state") != "", F.concat(F.lit("unclosed "), F.substring_index("state", " ", -1)))
    roots = F.when((of("body") != 1) | (of("/body") != 1), F.concat_ws(" ", of("body").cast("string"), of("/body").cast("string")))
    both = tags.withColumn("state", state)
    return _violations(both.withColumn("e", error).where("e is not null"), "balance", F.col("e"), "doc_id").unionByName(_violations(both.withColumn("e", roots).where("e is not null"), "body_roots", F.col("e"), "doc_id"))


def check_duplicate_attributes(bodies: DataFrame) -> DataFrame:
    """Attributes that a tag names twice: ``bodies`` has doc_id, html."""
    tags = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), F.lit(r"""<[A-Za-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""), 0)
    each = bodies.select("doc_id", F.explode(tags).alias("t")).where(F.col("t").contains("="))
    bare = F.regexp_replace("t", r"""=\s*(?:"[^"]*+"|'[^']*+'|[^\s>"']++)""", " ")
    names = F.transform(F.regexp_extract_all(F.regexp_replace(bare, r"^<[^\s/>]*", ""), F.lit(r"[^\s/>=]+"), 0), lambda n: F.lower(n))
    twice = F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1))
    return _violations(each.select("doc_id", F.explode(twice).alias("n")).distinct(), "duplicate_attribute", F.col("n"), "doc_id")


def check_forbidden(nodes: DataFrame) -> DataFrame:
    """Forbidden elements, executable attributes and destinations."""
    tags = _violations(nodes.where(F.col("tag").isin(FORBIDDEN_TAGS)), "forbidden_tag", F.col("tag"))
    each = nodes.where("kind = 'el'").select("page_id", F.explode("attrs").alias("name", "value"))
    code = each.where(F.lower("name").rlike("^on") | F.lower("name").isin("srcdoc") | (F.lower("name").isin("href", "src", "action", "formaction", "xlink:href") & F.regexp_replace(F.lower("value"), r"[\s\x00-\x1f]", "").rlike("^(?:javascript|vbscript|data:text/html)")))
    return tags.unionByName(_violations(code, "executable_attribute", F.col("name")))


def check_comments(nodes: DataFrame, markers: list[str]) -> DataFrame:
    """Comments that leak a marker, spaced or not."""
    rows = nodes.where("kind = 'comment'")
    hits = F.array_compact(F.array(*[F.when(norm(F.col("text")).contains(m.lower()) | compact(F.col("text")).contains("".join(c for c in m.lower() if c.isalnum())), m) for m in markers]))
    return _violations(rows.select("page_id", F.explode(hits).alias("m")), "comment_marker", F.col("m"))


def _classes(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'el'").select("page_id", "node_id", "parent_id", F.explode(F.array_distinct("classes")).alias("class"))


def check_class_catalog(nodes: DataFrame, catalog: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """Classes outside a catalog (``class``), and forbidden ones."""
    used = _classes(nodes).select("page_id", "class").distinct()
    out = _violations(used.join(catalog, "class", "left_anti"), "class_outside_catalog", F.col("class"))
    return out if forbidden is None else out.unionByName(_violations(used.join(forbidden, "class", "left_semi"), "class_forbidden", F.col("class")))


def check_class_counts(nodes: DataFrame, required: DataFrame) -> DataFrame:
    """Classes whose number of elements differs: ``required`` has doc_id, class, n.  Other cases of a class are errors."""
    used = _classes(nodes).groupBy(F.col("page_id").alias("doc_id"), F.lower("class").alias("low")).agg(F.count("*").alias("have"), F.count_if(F.col("class") != F.lower("class")).alias("odd"))
    both = required.withColumn("low", F.lower("class")).join(used, ["doc_id", "low"], "left")
    bad = both.where((F.coalesce("have", F.lit(0)) != F.col("n")) | (F.coalesce("odd", F.lit(0)) > 0))
    return _violations(bad, "class_count", F.concat_ws(" ", "class", F.coalesce("have", F.lit(0)), F.lit("of"), "n"), "doc_id")


def check_child_sequence(nodes: DataFrame, required: DataFrame) -> DataFrame:
    """Parents of a class whose children's first classes are not the ordered list: ``required`` has doc_id, class, children."""
    kids = nodes.where("kind = 'el' and parent_id is not null").groupBy("page_id", "parent_id").agg(F.sort_array(F.collect_list(F.struct("node_id", F.coalesce(F.try_element_at("classes", F.lit(1)), F.lit("")).alias("c")))).alias("k"))
    parents = _classes(nodes).select(F.col("page_id").alias("doc_id"), "page_id", F.col("node_id").alias("parent_id"), "class").join(required, ["doc_id", "class"])
    have = F.coalesce(F.transform("k", lambda x: x["c"]), F.array().cast("array<string>"))
    return _violations(parents.join(kids, ["page_id", "parent_id"], "left").where(~have.eqNullSafe(F.col("children"))), "child_sequence", F.col("class"))


def surfaces(nodes: DataFrame) -> DataFrame:
    """What a page exposes: doc_id, surface (visual or attribute), text."""
    seen = P.segments(nodes).select(F.col("page_id").alias("doc_id"), F.lit("visual").alias("surface"), F.col("segment").alias("text"))
    return seen.unionByName(P.attribute_text(nodes).select(F.col("page_id").alias("doc_id"), F.lit("attribute").alias("surface"), "text"))


def _outside(found: DataFrame, contract: DataFrame, kind: str, rule: str) -> DataFrame:
    """Values found (doc_id, value) that the contract (doc_id, kind, value) does not allow."""
    allowed = contract.where(F.col("kind") == kind).select("doc_id", "value").distinct()
    return _violations(found.distinct().join(allowed, ["doc_id", "value"], "left_anti"), rule, F.col("value"), "doc_id")


_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "
_MARK = "\ue000"
#: A phone with marks anywhere in it or at its ends.
_MARKED_PHONE = f"(?<![0-9]{_MARK}{{0,8}}){_MARK}*(?:\\+?{_MARK}*1[\\s()./{_MARK}-]*)?\\(?{_MARK}*[2-9](?:{_MARK}*[0-9]){{2}}{_MARK}*\\)?[\\s./{_MARK}-]*[2-9](?:{_MARK}*[0-9]){{2}}[\\s./{_MARK}-]*[0-9](?:{_MARK}*[0-9]){{3}}{_MARK}*(?![0-9])"


def scan_text(text: Column, mark: str = "") -> Column:
    """A text as contacts are read in it: wide forms, digits of all scripts and dashes as ASCII, format characters gone, directional ones as a mark."""
    plain = C.ascii_digits(F.translate(text, _WIDE, _NARROW))
    plain = F.regexp_replace(F.regexp_replace(plain, f"[{DIRECTIONAL}]", mark), r"\p{Pd}", "-")
    return F.regexp_replace(plain, r"\p{Cf}", "")


def check_contacts(exposed: DataFrame, contract: DataFrame) -> DataFrame:
    """Phones, e-mails, street and postal addresses outside the contract's ``phone, email, address`` values, and phones with directional characters in them.

    An address is allowed if its letters and digits stand in one of the contract's addresses.
    """
    text, all_of = F.col("text"), lambda c, p: F.regexp_extract_all(c, F.lit(p), 0)
    seen = exposed.select("doc_id", "text", scan_text(text).alias("plain"))
    as_rule = lambda rule, values: F.transform(values, lambda v: F.struct(F.lit(rule).alias("kind"), v.alias("value")))
    turned = F.when(text.rlike(f"[{DIRECTIONAL}]"), F.filter(all_of(scan_text(text, _MARK), _MARKED_PHONE), lambda v: v.contains(_MARK))).otherwise(F.array().cast("array<string>"))
    exact = F.concat(as_rule("phone", F.transform(all_of("plain", PHONE_LIKE), X.phone_key)), as_rule("email", F.transform(all_of("plain", P.EMAIL), F.lower)), as_rule("directional", F.transform(turned, X.phone_key)))
    own = contract.select("doc_id", "kind", F.when(F.col("kind") == "phone", X.phone_key(scan_text(F.col("value")))).when(F.col("kind") == "email", F.lower(F.trim("value"))).otherwise(F.col("value")).alias("value"))
    found = seen.select("doc_id", F.explode(F.array_distinct(exact)).alias("f")).select("doc_id", "f.*").distinct()
    lost = found.join(own.where("kind in ('phone', 'email')"), ["doc_id", "kind", "value"], "left_anti")
    rule = F.when(F.col("kind") == "directional", "directional_phone").otherwise(F.concat("kind", F.lit("_outside_source")))
    lost = lost.select(F.col("doc_id").cast("long").alias("doc_id"), rule.alias("rule_id"), F.col("value").alias("evidence"))
    places = seen.select("doc_id", F.explode(F.array_distinct(F.concat(all_of("plain", STREET_LIKE), all_of("plain", POSTAL_LIKE)))).alias("raw")).distinct()
    allowed = own.where("kind = 'address'").select("doc_id", compact(F.col("value")).alias("whole"))
    held = places.join(allowed, "doc_id", "left").groupBy("doc_id", "raw").agg(F.max(F.coalesce(F.col("whole").contains(compact(F.col("raw"))), F.lit(False))).alias("known"))
    return lost.unionByName(_violations(held.where("not known"), "address_outside_source", F.col("raw"), "doc_id"))


def check_locations(exposed: DataFrame, contract: DataFrame) -> DataFrame:
    """Service radii in miles outside the contract's ``radius`` values."""
    found = exposed.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RADIUS), 1)).alias("value"))
    return _outside(found, contract, "radius", "radius_outside_source")


def check_tenure(exposed: DataFrame, contract: DataFrame) -> DataFrame:
    """Years that are not the contract's ``established`` year or ``years``, and generic tenure."""
    year = exposed.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(ESTABLISHED), 1)).alias("value"))
    years = exposed.select("doc_id", F.explode(F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), 1) for p in TENURES]))).alias("value"))
    generic = exposed.where(F.col("text").rlike(GENERIC_TENURE))
    out = _outside(year, contract, "established", "established_year").unionByName(_outside(years, contract, "years", "years_in_business"))
    return out.unionByName(_violations(generic, "generic_tenure", F.regexp_extract("text", GENERIC_TENURE, 0), "doc_id"))


def check_images(images: DataFrame, contract: DataFrame) -> DataFrame:
    """Image URLs on any surface outside the contract's ``image`` values."""
    return _outside(images.select(F.col("page_id").alias("doc_id"), F.col("url").alias("value")), contract, "image", "image_outside_manifest")


def check_exact_claims(exposed: DataFrame, claims: DataFrame) -> DataFrame:
    """Triggers that do not start their whole phrase, place by place: ``claims`` has doc_id, trigger, phrase."""
    both = exposed.join(claims, "doc_id").withColumns({"t": norm(F.col("text")), "g": norm(F.col("trigger")), "p": norm(F.col("phrase"))})
    alone = F.concat(F.lit(r"(?<!\w)(?!\Q"), F.col("p"), F.lit(r"\E(?!\w))\Q"), F.col("g"), F.lit(r"\E(?!\w)"))
    return _violations(both.where(F.rlike(F.col("t"), alone)), "exact_claim", F.col("trigger"), "doc_id")


def check_required_values(exposed: DataFrame, required: DataFrame) -> DataFrame:
    """Required values (doc_id, value) that no surface holds as whole words, spaces and signs aside."""
    from .contracts import contains_tokens

    held = required.join(exposed, "doc_id").where(contains_tokens(F.col("text"), F.col("value"))).select("doc_id", "value").distinct()
    return _violations(required.join(held, ["doc_id", "value"], "left_anti"), "required_value", F.col("value"), "doc_id")


def check_forbidden_phrases(exposed: DataFrame, phrases: list[str]) -> DataFrame:
    """Phrases that may not be exposed, as they stand or run together."""
    hits = F.array_compact(F.array(*[F.when(norm(F.col("text")).contains(p.lower()) | compact(F.col("text")).contains("".join(c for c in p.lower() if c.isalnum())), p) for p in phrases]))
    return _violations(exposed.select("doc_id", F.explode(hits).alias("p")).distinct(), "forbidden_phrase", F.col("p"), "doc_id")


def check_placeholders(exposed: DataFrame, tokens: DataFrame) -> DataFrame:
    """Double-brace placeholders, and bracket tokens of a catalog (``token``)."""
    braces = exposed.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\{\{[^}]*\}\}"), 0)).alias("token"))
    brackets = exposed.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\[\]]+\]"), 0)).alias("token")).join(tokens, "token", "left_semi")
    return _violations(braces.unionByName(brackets).distinct(), "placeholder", F.col("token"), "doc_id")


def check_testimonials(nodes: DataFrame, exposed: DataFrame) -> DataFrame:
    """Quotation elements and prose attributed to a person."""
    prose = exposed.where((F.col("surface") == "visual") & F.col("text").rlike(ATTRIBUTED))
    return _violations(nodes.where(F.col("tag").isin(TESTIMONIAL_TAGS)), "testimonial_tag", F.col("tag")).unionByName(_violations(prose, "attributed_prose", F.regexp_extract("text", ATTRIBUTED, 0), "doc_id"))


def _field_text(nodes: DataFrame, cls: str) -> DataFrame:
    """Text of the elements of a class: doc_id, node_id, text."""
    own = nodes.where(F.array_contains("classes", cls))
    return own.select("page_id", "node_id").join(P._inner_text(nodes, own), ["page_id", "node_id"], "left").select(F.col("page_id").alias("doc_id"), "node_id", F.coalesce("text", F.lit("")).alias("text"))


def check_class_text(nodes: DataFrame, cls: str, required: DataFrame) -> DataFrame:
    """Documents whose texts of a class are not the list (doc_id, values), in order."""
    have = _field_text(nodes, cls).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]).alias("have"))
    both = required.join(have, "doc_id", "left")
    return _violations(both.where(~F.coalesce("have", F.array().cast("array<string>")).eqNullSafe(F.col("values"))), "class_text", F.lit(cls), "doc_id")


def check_review_cards(cards: DataFrame, reviews: DataFrame) -> DataFrame:
    """Cards (doc_id, author, rating, date, platform, text) without a source review of their own that agrees in all of these: the n-th use needs the n-th copy."""
    keys = ["doc_id", "author", "rating", "date", "platform", "text"]
    told = {c: norm(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("author", "date", "platform", "text")} | {"rating": F.col("rating").cast("double")}
    alike = lambda df, m: df.select(*keys, (F.lit(None).cast("string") if m else F.col("author")).alias("shown"), F.lit(m).alias("m")).withColumns(told)
    # both stand together by document: a card is lost where as many cards as there are reviews go before it; null matches nothing
    both = alike(cards, 0).unionByName(alike(reviews, 1)).repartition("doc_id").groupBy(*keys, "shown").agg(F.count_if(F.col("m") == 0).alias("n"), F.count_if((F.col("m") == 1) & F.col("rating").isNotNull() & F.col("doc_id").isNotNull()).alias("m"))
    every = Window.partitionBy(*keys)
    over = F.least("n", F.sum("n").over(every.orderBy("shown")) - F.sum("m").over(every))
    lost = both.withColumn("over", over).where("over > 0").withColumn("over", F.explode(F.sequence(F.lit(1), F.col("over"))))
    return _violations(lost, "review_without_source", F.col("shown"), "doc_id")


def check_form(nodes: DataFrame, contract: DataFrame) -> DataFrame:
    """Documents without exactly one form that goes to the contract's ``form_action``."""
    forms = nodes.where("tag = 'form'").groupBy(F.col("page_id").alias("doc_id")).agg(F.count("*").alias("n"), F.min(F.coalesce(P.attr("action"), F.lit(""))).alias("action"))
    both = contract.where("kind = 'form_action'").join(forms, "doc_id", "left")
    return _violations(both.where((F.coalesce("n", F.lit(0)) != 1) | ~F.col("action").eqNullSafe(F.col("value"))), "form", F.col("action"), "doc_id")


def check_actions(links: DataFrame, contract: DataFrame) -> DataFrame:
    """Link destinations outside the contract's ``action`` values; fragments of the page itself pass."""
    found = links.where(~F.col("href").startswith("#")).select(F.col("page_id").alias("doc_id"), F.col("href").alias("value"))
    return _outside(found, contract, "action", "action_outside_source")


def check_visible_copy(exposed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Visible texts outside a document's closed catalog (doc_id, value)."""
    found = exposed.where("surface = 'visual'").select("doc_id", norm(F.col("text")).alias("value"))
    return _outside(found, catalog.select("doc_id", F.lit("copy").alias("kind"), norm(F.col("value")).alias("value")), "copy", "copy_outside_catalog")


def verdicts(docs: DataFrame, violations: DataFrame, order: list[str]) -> DataFrame:
    """Each document with ``admitted``, its first rule by ``order`` (others last) and the number of violations."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("rule_id")), F.lit(0)), F.lit(len(order) + 1))
    by = violations.groupBy("doc_id").agg(F.min_by("rule_id", F.struct(place, "rule_id")).alias("first_rule"), F.count("*").alias("n"))
    return docs.select("doc_id").join(by, "doc_id", "left").select("doc_id", F.col("first_rule").isNull().alias("admitted"), "first_rule", F.coalesce("n", F.lit(0)).alias("n_violations"))


def pick_attempt(attempts: DataFrame) -> DataFrame:
    """The first admitted attempt (of at most two) of each document, with the error of the attempt before.

    ``attempts`` has doc_id, attempt, admitted, first_rule, html.
    """
    before = F.lag("first_rule").over(Window.partitionBy("doc_id").orderBy("attempt"))
    own = attempts.where("attempt <= 2").withColumn("previous_error", before)
    return own.where("admitted").groupBy("doc_id").agg(F.min_by(F.struct("attempt", "html", "previous_error"), "attempt").alias("a")).select("doc_id", "a.*")
