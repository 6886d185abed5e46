"""Queries over customers and suppliers as business records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import records as R

_THEMES = ["broadcast", "civic", "warm", "minimal"]
_PALETTES = ["#1d4ed8", "#b45309", "#15803d"]


def design_selections(spark, sf_dir):
    """Theme, palette, section order and hero shape of each customer by its name's digest."""
    name = F.col("c_name")
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    df = df.withColumns({"theme": R.pick_theme(name, _THEMES), "palette": R.pick(name, _PALETTES, 8), "section_order": R.pick_section_order(name)})
    return df.withColumn("hero_shape", R.pick_hero_shape(F.col("theme"), F.col("c_custkey") % 2 == 0))


def record_names(spark, sf_dir):
    """Slug of each supplier's name."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", X.slugify(F.col("s_name")).alias("slug"))


def section_order_balance(spark, sf_dir):
    """How evenly the digest deals section orders over nations."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.groupBy("c_nationkey", R.pick_section_order(F.col("c_name")).alias("section_order")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (design_selections, record_names, section_order_balance)}


def _pick(options, start, col="c_name"):
    whens = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE ('0x' || substring(md5(lower(trim({col}))), {start + 1}, 8))::BIGINT % {len(options)} {whens} END"


_SHAPE = "CASE theme " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in R.HERO_SHAPES.items()) + " END"
ORACLE_SQL = {
    "design_selections": f"""WITH p AS (SELECT c_custkey, c_name, {_pick(_THEMES, 0)} AS theme, {_pick(_PALETTES, 8)} AS palette, {_pick(R.SECTION_ORDERS, 16)} AS section_order FROM customer)
SELECT *, CASE WHEN {_SHAPE} IN ('fullbleed', 'split') AND c_custkey % 2 <> 0 THEN 'gradient' ELSE {_SHAPE} END AS hero_shape FROM p""",
    "record_names": "SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM supplier",
    "section_order_balance": f"SELECT c_nationkey, {_pick(R.SECTION_ORDERS, 16)} AS section_order, count(*) AS n FROM customer GROUP BY 1, 2",
}
