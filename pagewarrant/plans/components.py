"""Queries that make bodies, records and catalogs of customers, suppliers, parts and pages, and check their components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import catalogs as K
from ..operators import components as M
from ..operators import contracts as C
from ..sources import dom
from ..sources.tables import read_table
from .registry import _site_json


def _table(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(template: str, **values):
    """A text with ``{name}`` replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def tag_balance(spark, sf_dir):
    """Tags of pages' bodies that do not balance, roots and repeated attributes; some bodies are mended, some spoilt."""
    k = F.col("page_id")
    body = F.regexp_extract("html", "(?s)<body>.*</body>", 0)
    plain = F.regexp_replace(body, "</?(?:p|b)>", "")
    own = F.when(k % 4 == 0, plain).when(k % 4 == 2, F.replace(plain, F.lit("</footer>"), F.lit("</em></footer>"))).when(k % 4 == 3, F.replace(plain, F.lit("<footer>"), F.lit("<footer/>"))).otherwise(body)
    twice = F.when(k % 6 == 1, F.replace(own, F.lit('<div class="ad">'), F.lit('<div class="ad" id=a CLASS=x>'))).otherwise(own)
    bodies = read_table(spark, sf_dir, "pages").select(k.alias("doc_id"), F.concat(twice, F.when(k % 5 == 0, "</body>").otherwise("")).alias("html"))
    return A.check_balance(bodies).unionByName(A.check_duplicate_attributes(bodies))


AGGREGATE = (
    '<div class="reviews-aggregate"><span class="reviews-stars-lg" style="--score: {style}">★★★★★</span><div class="reviews-score">{score} <span class="of-five">out of 5</span></div>'
    '<div class="reviews-count">Based on {count} reviews on Google</div><a class="reviews-cta{cls}" href="{href}">{link}</a>{more}</div>'
)
SUMMARY = (
    '<div class="reviews-summary-row"><span class="reviews-summary-stars" style="color:red; --score:{style}">★★★★★</span><span class="reviews-summary-text"><strong>{score} out of 5</strong> · Based on {count} Google Reviews</span>'
    '<a class="reviews-summary-cta{cls}" href="{href}">{link}</a>{more}</div>'
)


def review_summaries(spark, sf_dir):
    """Customers' bodies with a review summary of either layout, some spoilt in one part."""
    k = F.col("c_custkey")
    score, count, url = F.concat(k % 5, F.lit(".5")), k % 100, F.concat(F.lit("https://g.example/"), k)
    parts = dict(
        score=score, style=F.when(k % 7 == 1, "9").otherwise(score), count=F.when(k % 9 == 1, count + 1).otherwise(count), cls=F.when(k % 17 == 1, " big").otherwise(""), href=F.when(k % 11 == 1, "/x").otherwise(url),
        link=F.when(k % 13 == 1, "More").when(k % 2 == 0, "Read all reviews on Google").otherwise("Read all on Google"), more=F.when(k % 19 == 1, "<b></b>").otherwise(""),
    )
    c = _table(spark, sf_dir, "customer")
    bodies = c.select("c_custkey", F.when(k % 2 == 0, _text(AGGREGATE, **parts)).otherwise(_text(SUMMARY, **parts)).alias("html"))
    contract = c.select(k.alias("doc_id"), F.when(k % 2 == 0, "aggregate").otherwise("summary").alias("layout"), F.when(k % 23 != 1, score).alias("score"), count.alias("count"), url.alias("url"))
    return M.check_review_summary(dom.explode_dom(bodies, "c_custkey"), contract)


def ambient_reviews(spark, sf_dir):
    """Orders as texts that claim scores and counts of reviews, against their customer's."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    contract = _table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.when(k % 7 != 0, F.concat(k % 5, F.lit(".5"))).alias("score"), F.when(k % 8 != 0, k % 10).alias("count"))
    text = F.when(o % 4 == 0, F.concat(F.lit("Rated "), F.col("o_custkey") % 5, F.lit(".5 today"))).when(o % 4 == 1, F.concat(o % 10, F.lit("  Google reviews"))).when(o % 4 == 2, "Rating 4.5 by 40 customers").otherwise("5 of these")
    return M.check_ambient_reviews(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), text.alias("text")), contract)


def star_widgets(spark, sf_dir):
    """Customers' bodies with star widgets outside summaries."""
    k = F.col("c_custkey")
    html = _text(
        '<p>{first}</p><span class="{name}" style="--score: {score}"{more}>★★★★★</span>',
        first=F.col("c_name"), name=F.when(k % 5 == 1, "form-trust-stars").when(k % 2 == 0, "trust-stars").otherwise("cta-trust-stars"), score=F.when(k % 7 == 1, "1").otherwise("4.5"), more=F.when(k % 11 == 1, ' id="x"').otherwise(""),
    )
    c = _table(spark, sf_dir, "customer")
    return M.check_star_widgets(dom.explode_dom(c.select("c_custkey", html.alias("html")), "c_custkey"), c.select(k.alias("doc_id"), F.when(k % 13 != 1, "4.5").alias("score")))


def service_cards(spark, sf_dir):
    """Suppliers' bodies with two service cards, against their services."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    card = '<div class="service-card"{hidden}><h3 class="service-card-name">{name}</h3>{desc}</div>'
    desc = lambda n: F.concat(F.lit('<p class="service-card-desc">Ask us  about '), n, F.lit("</p>"))
    fix = F.concat(F.lit("Fix "), k)
    first = _text(card, hidden=F.when(k % 11 == 1, " hidden").otherwise(""), name=name, desc=desc(name))
    second = _text(card, hidden=F.lit(""), name=F.when(k % 7 == 1, "Other").otherwise(fix), desc=F.when(k % 5 == 1, "").otherwise(desc(fix)))
    s = _table(spark, sf_dir, "supplier")
    return M.check_service_cards(dom.explode_dom(s.select("s_suppkey", F.concat(first, second).alias("html")), "s_suppkey"), s.select(k.alias("doc_id"), F.array(name, fix).alias("services")))


def page_structure(spark, sf_dir):
    """Classes and children that the page of each customer as a record must have."""
    k = F.col("c_custkey")
    records = _table(spark, sf_dir, "customer").select(
        k.alias("doc_id"), (k % 5 != 0).alias("has_phone"), (k % 4).cast("int").alias("n_services"), F.when(k % 3 == 0, "cards").when(k % 3 == 1, "aggregate").otherwise("omit").alias("mode"), (k % 2 == 0).alias("has_aggregate")
    )
    children = M.required_children(records).select("doc_id", "class", F.array_join("children", " ").alias("value"))
    return M.required_classes(records).select("doc_id", "class", F.col("n").cast("string").alias("value")).unionByName(children)


def document_colors(spark, sf_dir):
    """Colours of customers' pages by brand colours of any form, palette or default."""
    k = F.col("c_custkey")
    forms = ['"#a1b2c3"', '["#010203", "#0a0b0c"]', '{"primary": "#ffffff", "dark": "#000000"}', "[]", '"blue"', '{"secondary": "#111111"}', None, "7"]
    brand = F.try_parse_json(F.array(*map(F.lit, forms))[(k % 8).cast("int")])
    palette = F.when(k % 3 == 0, F.struct(F.lit("#222222").alias("accent"), F.lit("#333333").alias("accent_dark"), F.when(k % 2 == 0, "#444444").alias("secondary")))
    return _table(spark, sf_dir, "customer").select("c_custkey", C.document_colors(brand, palette, F.when(k % 5 == 0, "#555555")).alias("c")).select("c_custkey", "c.*")


def catalog_entries(spark, sf_dir):
    """Image searches and themes of sections named after parts."""
    k = F.col("p_partkey")
    link = '<link href="https://fonts.googleapis.com/css2?f={type}" rel="stylesheet">'
    theme = _text(link + "\n--font-display: {type};\n--font-body: x y ;\n{serif}\n--card-radius: {radius};  \n", type=F.col("p_type"), serif=F.when(k % 5 == 1, "").otherwise("--font-serif: s;"), radius=F.when(k % 7 == 1, "{1px").otherwise("1px"))
    trade = F.concat(F.lit("text\n"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit('  hero_search_query: " '), F.col("p_type"), F.lit(' van"\n'))))
    sections = _table(spark, sf_dir, "part").select(F.when(k % 2 == 0, F.concat(F.lit("TRADE: "), "p_name", F.lit(" "), k)).otherwise(F.concat("p_name", F.lit(" "), k, F.lit(" -- about"))).alias("heading"), F.when(k % 2 == 0, trade).otherwise(theme).alias("body"))
    themes = K.theme_defs(sections).select(F.col("theme").alias("name"), F.coalesce("error", F.concat_ws("|", "font_link", F.array_join(F.map_values("props"), "|"))).alias("value"))
    return K.trade_queries(sections).select(F.col("trade").alias("name"), F.col("query").alias("value")).unionByName(themes)


def action_labels(spark, sf_dir):
    """Neutral labels that customers' pages may use by their channels."""
    k = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer")
    catalog = c.select(k.alias("doc_id"), F.explode(F.array(F.col("c_mktsegment"), *map(F.lit, ["text", "Call", "call us", "Email  Us", "Learn more"]))).alias("value"))
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    rows = F.array_compact(F.array(F.when(k % 2 == 0, row("phone", F.lit("1"))), F.when(k % 3 == 0, row("email", F.lit("a@b.org"))), row("action", F.when(k % 5 == 0, "SMS:+1").otherwise("https://x.example"))))
    return C.neutral_labels(catalog, c.select(k.alias("doc_id"), F.inline(rows)))


def record_places(spark, sf_dir):
    """Places and images that customers' pages may name."""
    k = F.col("c_custkey")
    photo = lambda url, path: F.struct(url.alias("url"), F.lit(" ").alias("src"), path.alias("path"))
    photos = F.when(k % 5 != 0, F.array(photo(F.when(k % 2 == 0, "a.png"), F.lit("own.png")), photo(F.lit("a.png "), F.concat(F.lit("p"), k))))
    df = _table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") != 3, "town").alias("city"), F.lit("IL").alias("state"), F.when(k % 4 == 0, " ").otherwise("20 miles").alias("service_radius"), F.when(k % 2 == 1, "  12 Main ").alias("address"), F.when(k % 7 == 0, " own.png").otherwise(" ").alias("logo"), photos.alias("photos")
    )
    images = C.record_images(df, "c_custkey").select("doc_id", F.concat(F.when(F.col("is_logo"), "logo").otherwise("image"), F.lit(" "), "ord").alias("kind"), "value")
    return C.contract_locations(df, "c_custkey").unionByName(images)


def canonical_images(spark, sf_dir):
    """Image claims of suppliers' site documents, resolved against the sites that have a URL."""
    docs = _site_json(spark, sf_dir)
    sites = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("https://s.example/"), "s_suppkey", F.lit("/a"))).alias("base_url"))
    return C.canonical_images(C.flatten_claims(docs.select("doc_id", F.try_parse_json("json").alias("doc"))), sites).where("kind in ('image', 'logo')").select("doc_id", "path", "value")


QUERIES = {f.__name__: f for f in (tag_balance, review_summaries, ambient_reviews, star_widgets, service_cards, page_structure, document_colors, catalog_entries, action_labels, record_places, canonical_images)}

_VOID = ", ".join(f"'{v}'" for v in sorted(dom.VOID))
_TAG = r"""</?[A-Za-z](?:[^"''>]|"[^"]*"|''[^'']*'')*>"""
_ONCE = "', '".join(M.PAGE_CLASSES)
ORACLE_SQL = {
    "tag_balance": rf"""WITH b AS (SELECT page_id AS k, regexp_extract(html, '(?s)<body>.*</body>', 0) AS body, regexp_replace(regexp_extract(html, '(?s)<body>.*</body>', 0), '</?(?:p|b)>', '', 'g') AS plain FROM pages),
v AS (SELECT k, CASE k % 4 WHEN 0 THEN plain WHEN 2 THEN replace(plain, '</footer>', '</em></footer>') WHEN 3 THEN replace(plain, '<footer>', '<footer/>') ELSE body END AS h FROM b),
w AS (SELECT k, regexp_replace(CASE WHEN k % 6 = 1 THEN replace(h, '<div class="ad">', '<div class="ad" id=a CLASS=x>') ELSE h END || CASE WHEN k % 5 = 0 THEN '</body>' ELSE '' END, '<!--.*?-->', '', 'gs') AS h FROM v WHERE h IS NOT NULL),
x AS (SELECT k, h, list_transform(regexp_extract_all(regexp_replace(regexp_replace(h, '<script\b[^>]*>.*?</script\s*>', '<script></script>', 'gis'), '<style\b[^>]*>.*?</style\s*>', '<style></style>', 'gis'), '{_TAG}'),
  lambda t: CASE WHEN t LIKE '</%' THEN '/' ELSE '' END || lower(regexp_extract(t, '^</?([A-Za-z][^\s/>]*)', 1)) || CASE WHEN t LIKE '%/>' AND t NOT LIKE '</%' THEN '/' ELSE '' END) AS tags FROM w),
f AS (SELECT k, tags, list_reduce(list_prepend('', list_filter(tags, lambda t: t NOT IN ('body', '/body'))), lambda s, t: CASE WHEN s LIKE '!%' THEN s
  WHEN t LIKE '/%' THEN CASE WHEN t[2:] IN ({_VOID}) THEN '!void ' || t[2:] WHEN s = '' THEN '!unexpected ' || t[2:] WHEN string_split(s, ' ')[-1] <> t[2:] THEN '!misnested ' || t[2:] || ' in ' || string_split(s, ' ')[-1] ELSE left(s, length(s) - length(t)) END
  WHEN t LIKE '%/' THEN CASE WHEN t[:-2] IN ({_VOID}) OR t[:-2] = 'svg' OR contains(s || ' ', ' svg ') THEN s ELSE '!self_closed ' || t[:-2] END WHEN t IN ({_VOID}) THEN s ELSE s || ' ' || t END) AS s FROM x)
SELECT k AS doc_id, 'balance' AS rule_id, CASE WHEN s LIKE '!%' THEN s[2:] ELSE 'unclosed ' || string_split(s, ' ')[-1] END AS evidence FROM f WHERE s <> ''
UNION ALL SELECT k, 'body_roots', len(list_filter(tags, lambda t: t = 'body')) || ' ' || len(list_filter(tags, lambda t: t = '/body')) FROM x WHERE len(list_filter(tags, lambda t: t = 'body')) <> 1 OR len(list_filter(tags, lambda t: t = '/body')) <> 1
UNION ALL SELECT k, 'duplicate_attribute', 'class' FROM x WHERE contains(h, ' id=a CLASS=x>')""",
    "review_summaries": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'reviews-aggregate' ELSE 'reviews-summary-row' END AS root, CASE WHEN c_custkey % 2 = 0 THEN 'reviews-cta' ELSE 'reviews-summary-cta' END AS cta FROM customer), s AS (SELECT * FROM c WHERE k % 23 <> 1)
SELECT k AS doc_id, 'component' AS rule_id, root || ' children' AS evidence FROM s WHERE k % 17 = 1 OR k % 19 = 1 UNION ALL SELECT k, 'component', cta || ' class' FROM s WHERE k % 17 = 1 UNION ALL SELECT k, 'review_score', '' FROM s WHERE k % 7 = 1
UNION ALL SELECT k, 'review_count', '' FROM s WHERE k % 9 = 1 UNION ALL SELECT k, 'review_link', '' FROM s WHERE k % 11 = 1 UNION ALL SELECT k, 'review_link_text', '' FROM s WHERE k % 13 = 1 UNION ALL SELECT k, 'review_evidence', root FROM c WHERE k % 23 = 1""",
    "ambient_reviews": """WITH t AS (SELECT DISTINCT o_custkey AS k, unnest(CASE o_orderkey % 4 WHEN 0 THEN [{'kind': 'score', 'v': (o_custkey % 5) || '.5'}] WHEN 1 THEN [{'kind': 'count', 'v': (o_orderkey % 10)::VARCHAR}]
  WHEN 2 THEN [{'kind': 'score', 'v': '4.5'}, {'kind': 'count', 'v': '40'}] ELSE [] END) AS c FROM orders)
SELECT k AS doc_id, 'ambient_review_' || c.kind AS rule_id, c.v AS evidence FROM t LEFT JOIN customer ON c_custkey = k WHERE c.v::DOUBLE IS DISTINCT FROM CASE WHEN c.kind = 'score' THEN CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 5 + 0.5 END ELSE CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 10 END END""",
    "star_widgets": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 1 THEN 'form-trust-stars' WHEN c_custkey % 2 = 0 THEN 'trust-stars' ELSE 'cta-trust-stars' END AS n FROM customer),
b AS (SELECT k, n, CASE WHEN k % 5 = 1 THEN 'no_overlay' WHEN k % 13 = 1 THEN 'unsourced' WHEN k % 11 = 1 THEN 'shape' WHEN k % 7 = 1 THEN 'score' END AS bad FROM c) SELECT k AS doc_id, 'star_widget' AS rule_id, n || ' ' || bad AS evidence FROM b WHERE bad IS NOT NULL""",
    "service_cards": """WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS doc_id, 'service_card' AS rule_id, 'hidden' AS evidence FROM s WHERE k % 11 = 1 UNION ALL SELECT k, 'service_card', 'description' FROM s WHERE k % 5 = 1
UNION ALL SELECT k, CASE WHEN k % 7 = 1 THEN 'service_names' ELSE 'service_descriptions' END, '' FROM s WHERE k % 7 = 1 OR k % 5 = 1""",
    "page_structure": f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS n, c_custkey % 3 AS m, c_custkey % 5 <> 0 AS phone, c_custkey % 2 = 0 AS agg FROM customer),
r AS (SELECT k, unnest(['{_ONCE}']) AS class, 1 AS kind, n, m, phone, agg FROM c UNION ALL SELECT k, unnest(['service-card', 'service-card-name', 'service-card-desc']), 2, n, m, phone, agg FROM c
  UNION ALL SELECT k, unnest(['reviews-card-grid', 'review-card', 'review-stars-sm', 'review-text', 'review-author', 'review-date', 'review-platform']), 3, n, m, phone, agg FROM c
  UNION ALL SELECT k, unnest(['reviews-summary-row', 'reviews-summary-stars', 'reviews-summary-text', 'reviews-summary-cta']), 4, n, m, phone, agg FROM c UNION ALL SELECT k, unnest(['reviews-aggregate', 'reviews-stars-lg', 'reviews-score', 'reviews-count', 'reviews-cta']), 5, n, m, phone, agg FROM c)
SELECT k AS doc_id, class, (CASE kind WHEN 1 THEN CASE WHEN class LIKE 'benefit-%' THEN 3 WHEN class = 'coverage-band' AND NOT phone THEN 0 ELSE 1 END WHEN 2 THEN n WHEN 3 THEN CASE WHEN m <> 0 THEN 0 WHEN class = 'reviews-card-grid' THEN 1 ELSE 3 END
  WHEN 4 THEN (m = 0 AND agg)::INT ELSE (m = 1)::INT END)::VARCHAR AS value FROM r
UNION ALL SELECT k, 'services-grid', trim(repeat('service-card ', n)) FROM c UNION ALL SELECT k, 'service-card', 'service-card-name service-card-desc' FROM c
UNION ALL SELECT k, 'benefits-grid', 'benefit-card benefit-card benefit-card' FROM c UNION ALL SELECT k, 'benefit-card', 'benefit-title benefit-desc' FROM c""",
    "document_colors": """WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS f, CASE WHEN c_custkey % 5 = 0 THEN '#555555' ELSE '#1F3A5F' END AS spare FROM customer),
d AS (SELECT k, CASE f WHEN 0 THEN ['#a1b2c3', '#798692', spare] WHEN 1 THEN ['#010203', '#010202', '#0a0b0c'] WHEN 2 THEN ['#ffffff', '#000000', spare] WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 7 THEN NULL
  ELSE CASE WHEN k % 3 = 0 THEN ['#222222', '#333333', CASE WHEN k % 2 = 0 THEN '#444444' ELSE spare END] ELSE ['#1D4ED8', '#163AA2', '#1F3A5F'] END END AS c, CASE f WHEN 4 THEN 'accent' WHEN 5 THEN 'brand' WHEN 7 THEN 'brand' END AS error FROM c)
SELECT k AS c_custkey, c[1] AS accent, c[2] AS accent_dark, c[3] AS secondary, error FROM d""",
    "catalog_entries": """SELECT p_name || ' ' || p_partkey AS name, p_type || ' van' AS value FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 6 <> 0
UNION ALL SELECT p_name || ' ' || p_partkey, CASE WHEN p_partkey % 5 = 1 THEN '--font-serif' WHEN p_partkey % 7 = 1 THEN 'unsafe --card-radius' ELSE '<link href="https://fonts.googleapis.com/css2?f=' || p_type || '" rel="stylesheet">|' || p_type || '|x y|s|1px' END FROM part WHERE p_partkey % 2 = 1""",
    "action_labels": """WITH l AS (SELECT c_custkey AS k, unnest(['text', 'Call', 'call us', 'Email  Us', 'Learn more']) AS label FROM customer),
o AS (SELECT * FROM l WHERE label = 'Learn more' OR (label IN ('Call', 'call us') AND k % 2 = 0) OR (label = 'Email  Us' AND k % 3 = 0) OR (label = 'text' AND k % 5 = 0))
SELECT k AS doc_id, label, row_number() OVER (PARTITION BY k ORDER BY lower(label), label)::INT AS ord FROM o""",
    "record_places": """WITH c AS (SELECT *, c_custkey AS k FROM customer), i AS (SELECT k, list_filter([CASE WHEN k % 7 = 0 THEN 'own.png' END, CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN 'a.png' END, CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN 'own.png' END,
  CASE WHEN k % 5 <> 0 AND k % 2 = 1 THEN 'a.png' END, CASE WHEN k % 5 <> 0 THEN 'p' || k END], lambda x: x IS NOT NULL) AS v FROM c)
SELECT k AS doc_id, 'city' AS kind, 'town' AS value FROM c WHERE c_nationkey <> 3 UNION ALL SELECT k, 'state', 'IL' FROM c UNION ALL SELECT k, 'radius', '20 miles' FROM c WHERE k % 4 <> 0 UNION ALL SELECT k, 'address', '12 Main' FROM c WHERE k % 2 = 1
UNION ALL SELECT k, CASE WHEN k % 7 = 0 AND o = 1 THEN 'logo ' ELSE 'image ' END || o, x FROM (SELECT k, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS o FROM i)""",
    "canonical_images": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'https://s.example/' || s_suppkey || '/' ELSE '' END AS b FROM supplier WHERE s_suppkey % 13 <> 0)
SELECT k AS doc_id, '$.brand.logo_url' AS path, b || 'u1' AS value FROM s WHERE k % 2 = 0 UNION ALL SELECT k, '$.images[0].url', b || 'u' || (k % 4) FROM s UNION ALL SELECT k, '$.images[1].url', b || 'u1' FROM s""",
}
