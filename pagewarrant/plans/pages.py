"""Queries over the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ground as G
from ..operators import pages as P
from ..sources import dom
from ..sources.tables import read_table
from .said import said_sql, stands_sql, told_sql


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def _nodes(spark, sf_dir):
    return dom.explode_dom(_pages(spark, sf_dir))


def page_links(spark, sf_dir):
    return P.links(_nodes(spark, sf_dir)).select("page_id", "ord", "href")


def page_headings(spark, sf_dir):
    return P.headings(_nodes(spark, sf_dir)).select("page_id", "level", "text")


def page_shape(spark, sf_dir):
    """Elements, comments, paragraphs and list items of each page."""
    nodes = _nodes(spark, sf_dir)
    count = lambda k: F.count_if(F.col("kind") == k)
    return nodes.groupBy("page_id").agg(count("el").alias("n_elements"), count("comment").alias("n_comments"), F.count_if(F.col("tag") == "p").alias("n_paragraphs"), F.count_if(F.col("tag") == "li").alias("n_items"))


def thin_pages(spark, sf_dir):
    return P.thin_content(_nodes(spark, sf_dir))


def page_segments(spark, sf_dir):
    return P.segments(_nodes(spark, sf_dir)).groupBy("page_id", "tag").agg(F.count("*").alias("n_segments"), F.sum(F.length("segment")).alias("n_chars"))


def fetchable_pages(spark, sf_dir):
    pages, nodes = _pages(spark, sf_dir), _nodes(spark, sf_dir)
    return P.fetchable(P.resolve_urls(P.links(nodes).select("page_id", "href"), pages, nodes), pages)


def contact_evidence(spark, sf_dir):
    """E-mail addresses and phone digits that documents state and do not deny."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    mails = P.emails(docs, "doc_id", "text").select("doc_id", F.lit("email").alias("kind"), F.col("email").alias("value"))
    return mails.unionByName(P.phones(docs, "doc_id", "text").select("doc_id", F.lit("phone").alias("kind"), F.col("digits").alias("value")))


def page_identity(spark, sf_dir):
    return P.identity_vote(P.identity_candidates(_nodes(spark, sf_dir)))


def _claims(links: DataFrame) -> DataFrame:
    """Each page's own links as claims of itself and, shifted by one page, of the next page."""
    own = links.select("page_id", "ord", "href", "label")
    return own.select(
        F.col("page_id").alias("doc_id"), F.explode(F.array(F.col("page_id"), F.col("page_id") + 1)).alias("page_id"), F.concat(F.lit("nav/"), F.col("ord")).alias("path"), F.lit("action").alias("kind"),
        F.col("label").alias("value"), F.col("href").alias("value2"), F.col("ord").alias("group_id"),
    ).withColumn("path", F.concat_ws("@", "path", "page_id"))


def grounded_actions(spark, sf_dir):
    links = P.links(_nodes(spark, sf_dir))
    return G.ground_action(_claims(links), links).select("doc_id", "page_id", "path", "grounded")


def grounded_labels(spark, sf_dir):
    """Link labels of a page as phrases in its own and the next page's texts."""
    nodes = _nodes(spark, sf_dir)
    return G.ground_text(_claims(P.links(nodes)), P.segments(nodes)).select("doc_id", "page_id", "path", "grounded", "reason")


QUERIES = {f.__name__: f for f in (page_links, page_headings, page_shape, thin_pages, page_segments, fetchable_pages, page_identity, contact_evidence, grounded_actions, grounded_labels)}

_BARE = r"regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs')"
_LINKS = rf"""l AS (SELECT page_id, unnest(range(1, len(h) + 1))::INT AS ord, unnest(h) AS href, unnest(t) AS label
 FROM (SELECT page_id, regexp_extract_all({_BARE}, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all({_BARE}, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages))"""
_C = """c AS (SELECT page_id AS doc_id, unnest([page_id, page_id + 1]) AS page_id, ord, href, lower(trim(label)) AS label FROM l)"""
_TEXT = r"""trim(regexp_replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))"""
_DECODED = """replace(replace(replace(replace(replace({}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&')"""
_SEGMENTS = rf"""seg AS (SELECT page_id, t FROM (SELECT page_id, unnest(list_transform(string_split_regex(regexp_replace(regexp_replace(substring({_BARE}, position('<body>' IN {_BARE}) + 6), '</?(?:a|b)\b[^>]*>', '', 'g'), '<br>', ' ', 'g'), '<[^>]*>'),
 lambda x: lower(trim(regexp_replace({_DECODED.format('x')}, '\s+', ' ', 'g'))))) AS t FROM pages) WHERE t <> '')"""
_DIGITS = r"regexp_replace({}, '[^0-9]', '', 'g')"
ORACLE_SQL = {
    "grounded_labels": rf"""WITH {_LINKS}, {_SEGMENTS}, c AS (SELECT page_id AS doc_id, unnest([page_id, page_id + 1]) AS page_id, ord, lower(trim({_DECODED.format('label')})) AS label FROM l),
m AS (SELECT c.doc_id, c.page_id, c.ord, max(CASE WHEN {said_sql('seg.t', 'c.label')} THEN 1 ELSE 0 END) AS ok FROM c JOIN seg ON seg.page_id = c.page_id AND contains(seg.t, c.label) AND regexp_matches(c.label, '[\pL\pN]')
 AND len(list_filter(range(1, len(string_split(seg.t, c.label))), lambda k: {stands_sql('seg.t', 'c.label')})) > 0 GROUP BY ALL)
SELECT c.doc_id, c.page_id, 'nav/' || c.ord || '@' || c.page_id AS path, coalesce(ok, 0) = 1 AS grounded, CASE WHEN ok = 1 THEN NULL WHEN ok IS NULL THEN 'absent' ELSE 'context' END AS reason FROM c LEFT JOIN m USING (doc_id, page_id, ord)""",
    "contact_evidence": rf"""WITH e AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]{{1,64}}@(?:[A-Z0-9-]{{1,63}}\.)+[A-Z]{{2,63}}')) AS raw FROM documents),
p AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '(?i)(?:\+?1[\s.()-]*)?(?:\(?\d{{3}}\)?[\s.()-]*)\d{{3}}[\s.-]*\d{{4}}(?:\s*(?:x|ext\.?)\s*\d+)?')) AS raw FROM documents),
v AS (SELECT doc_id, unnest([{_DIGITS.format('raw')}, {_DIGITS.format(r"regexp_replace(raw, '(?i)\s*(?:x|ext\.?)\s*\d+\s*$', '')")}]) AS d FROM p WHERE {told_sql('text', 'raw')}),
w AS (SELECT doc_id, unnest(CASE WHEN length(d) = 11 AND d[1] = '1' THEN [d, d[2:]] ELSE [d] END) AS d FROM v)
SELECT DISTINCT doc_id, 'email' AS kind, lower(raw) AS value FROM e WHERE {told_sql('text', 'raw')} UNION ALL SELECT DISTINCT doc_id, 'phone', d FROM w WHERE length(d) >= 7""",
    "page_headings": rf"""WITH h AS (SELECT page_id, unnest(regexp_extract_all({_BARE}, '<h([1-6])>(.*?)</h[1-6]>', 1)) AS l, unnest(regexp_extract_all({_BARE}, '<h([1-6])>(.*?)</h[1-6]>', 2)) AS t FROM pages)
SELECT page_id, l::INT AS level, {_TEXT.format('t')} AS text FROM h""",
    "page_links": f"WITH {_LINKS} SELECT page_id, ord, replace(href, '&amp;', '&') AS href FROM l",
    "page_shape": rf"""SELECT page_id, len(regexp_extract_all({_BARE}, '<[a-zA-Z]')) + len(regexp_extract_all(html, '<(?:script|style)\b')) AS n_elements,
 len(regexp_extract_all(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<!--')) AS n_comments,
 len(regexp_extract_all({_BARE}, '<p>')) AS n_paragraphs, len(regexp_extract_all({_BARE}, '<li>')) AS n_items FROM pages""",
    "grounded_actions": f"WITH {_LINKS}, {_C} SELECT doc_id, page_id, 'nav/' || ord || '@' || page_id AS path, EXISTS (SELECT 1 FROM l WHERE l.page_id = c.page_id AND l.href = c.href AND lower(trim(l.label)) = c.label) AS grounded FROM c",
    "thin_pages": rf"""WITH t AS (SELECT page_id, unnest(string_split_regex(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '<x>', 'gs'), '<!--.*?-->', '<x>', 'gs'), '<[^>]*>')) AS t FROM pages),
n AS (SELECT page_id, sum(length(regexp_replace({_DECODED.format('t')}, '^\s+|\s+$', '', 'g')))::BIGINT AS n FROM t GROUP BY 1) SELECT page_id, n AS n_visible, n < {P.THIN} AS thin FROM n""",
    "fetchable_pages": rf"""WITH {_LINKS} SELECT DISTINCT page_id, regexp_extract(url, '^https?://[^/?#]*') || regexp_replace(replace(href, '&amp;', '&'), '#.*$', '') AS target FROM l JOIN pages USING (page_id)
 WHERE regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) <> regexp_replace(replace(href, '&amp;', '&'), '#.*$', '')""",
}
