"""Queries over what pages expose: documents laid out as pages by the lengths of their sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import exposure as E
from ..operators import imagery as I
from ..sources import dom
from .scopes import _laid_out, _nodes, _once

_STEP, _FIRST = 37, 23456


def exposed_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and addresses that a page exposes and its source lacks.

    Each sentence shows five digits of its length, in line, as a block, or after a break with a tooltip;
    two that nothing parts make a number.  The source knows the number of the first two sentences, and addresses of even lengths.
    """
    digits = lambda n: F.lpad(((n * _STEP + _FIRST) % 100_000).cast("string"), 5, "0")
    mail = lambda n: F.concat(F.lit("s"), n.cast("string"), F.lit("@mail.test"))
    held = lambda tag, n: F.concat(F.lit(f"<{tag}>"), digits(n), F.lit(f"</{tag}>"))
    element = lambda x, n: F.when(n % 4 == 0, held("span", n)).when(n % 4 == 1, held("b", n)).when(n % 4 == 2, held("p", n)).otherwise(F.concat(F.lit("<br><i title='Mail "), mail(n), F.lit("'>"), digits(n), F.lit("</i>")))
    pages = _laid_out(spark, sf_dir, element, "section")
    known = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    first = F.concat(digits(F.length(F.get("s", F.lit(0)))), digits(F.length(F.get("s", F.lit(1)))))
    mails = F.transform(F.filter(F.transform("s", F.length), lambda n: n % 2 == 0), lambda n: known("email", mail(n + 1)))
    contract = pages.select(F.col("page_id").alias("doc_id"), F.explode(F.concat(F.array(known("phone", first)), mails)).alias("k")).select("doc_id", "k.*").where("value is not null").distinct()
    nodes = _once(dom.explode_dom(pages).repartition("page_id"))
    return A.check_contacts(_once(E.exposure_surfaces(nodes)), contract)


def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with their alternative texts: of metadata groups, and of pictures with their sources."""
    meta = lambda name, value: F.concat(F.lit(f"<meta property='{name}' content='"), value, F.lit("'>"))
    url = lambda n: F.concat(F.lit("/u"), n.cast("string"))
    picture = lambda x, n: F.concat(F.lit("<picture><source srcset='"), url(n), F.lit(".a 1x, "), url(n), F.lit(".b 2x'><span><img src='"), url(n), F.lit("' alt='"), x, F.lit("'></span></picture>"))
    names = ["og:image", "og:image:url", "og:image:alt", "twitter:image", "twitter:image:alt", "og:image:secure_url"]

    def element(x, n):
        out = picture(x, n)
        for k, name in enumerate(names):
            out = F.when(n % 8 == k, meta(name, x if name.endswith("alt") else url(n))).otherwise(out)
        return F.when(n % 8 == 7, F.concat(F.lit("<img src='"), url(n), F.lit("'>"))).otherwise(out)

    pairs = I.image_texts(_nodes(_laid_out(spark, sf_dir, element, "main")))
    return pairs.select(F.col("page_id").alias("doc_id"), "url", F.md5("alt").alias("alt_md5"))


QUERIES = {f.__name__: f for f in (exposed_contacts, image_texts)}

_LENGTHS = r"""k AS (SELECT doc_id, list_filter(list_transform(string_split(translate(coalesce(text, ''), '<>&"''', '     '), '. '), lambda x: trim(regexp_replace(x, '[ \t\n\f\r]+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents),
c AS (SELECT doc_id, unnest(s) AS t, unnest(range(1, len(s) + 1)) AS i, unnest(list_transform(s, lambda x: length(x))) AS n FROM k)"""
ORACLE_SQL = {
    "exposed_contacts": rf"""WITH {_LENGTHS}, d AS (SELECT *, lpad(((n * {_STEP} + {_FIRST}) % 100000)::VARCHAR, 5, '0') AS p FROM c),
w AS (SELECT *, CASE WHEN n % 4 IN (2, 3) THEN 1 ELSE 0 END + coalesce(lag(CASE WHEN n % 4 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i), 0) AS wall FROM d),
r AS (SELECT *, sum(wall) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM w),
x AS (SELECT doc_id, string_agg(p, '' ORDER BY i) AS t FROM r GROUP BY doc_id, run UNION SELECT doc_id, string_agg(p, '' ORDER BY i) FROM r GROUP BY doc_id),
f AS (SELECT doc_id, string_agg(p, '' ORDER BY i) AS t FROM d WHERE i <= 2 GROUP BY 1 HAVING count(*) = 2)
SELECT doc_id, 'phone_outside_source' AS rule_id, t AS evidence FROM x WHERE regexp_full_match(t, '[2-9]\d\d[2-9]\d{{6}}') AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = x.doc_id AND f.t = x.t)
UNION ALL SELECT DISTINCT doc_id, 'email_outside_source', 's' || n || '@mail.test' FROM c WHERE n % 4 = 3 AND NOT EXISTS (SELECT 1 FROM c e WHERE e.doc_id = c.doc_id AND e.n = c.n - 1)""",
    "image_texts": rf"""WITH {_LENGTHS}, m AS (SELECT *, CASE WHEN n % 8 IN (3, 4) THEN 'twitter' ELSE 'og' END AS family, '/u' || n AS url FROM c WHERE n % 8 < 6),
g AS (SELECT *, sum(CASE WHEN n % 8 IN (0, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, family ORDER BY i) AS grp FROM m),
p AS (SELECT u.doc_id, u.url, a.t FROM g u JOIN g a ON a.doc_id = u.doc_id AND a.family = u.family AND a.grp = u.grp AND a.i > u.i AND a.n % 8 IN (2, 4) AND u.n % 8 NOT IN (2, 4)
 UNION ALL SELECT doc_id, '/u' || n || unnest(['', '.a', '.b']), t FROM c WHERE n % 8 = 6)
SELECT DISTINCT doc_id, url, md5(t) AS alt_md5 FROM p""",
}
