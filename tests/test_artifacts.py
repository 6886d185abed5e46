"""File sets that are replaced whole or not at all."""

import pytest
from pyspark.sql import functions as F

from pagewarrant.sources import texts as S


def _rows(spark, path):
    return sorted((r["slug"], r["name"], r["body"]) for r in S.read_artifacts(spark, path).select("slug", "name", "body").collect())


def _df(spark, *rows):
    return spark.createDataFrame(list(rows), "slug string, name string, body string")


def test_sets_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_artifacts(_df(spark, ("a", "index", "1"), ("a", "about", "1"), ("b", "index", "1"), ("b", "index", "1"), (None, "x", "x")), path)
    assert _rows(spark, path) == [("a", "about", "1"), ("a", "index", "1"), ("b", "index", "1"), ("b", "index", "1")]
    S.write_artifacts(_df(spark, ("a", "index", "2"), ("a b/c=d", "index", None)), path)  # fewer files: the old set goes whole
    assert _rows(spark, path) == [("a", "index", "2"), ("a b/c=d", "index", None), ("b", "index", "1"), ("b", "index", "1")]
    S.write_artifacts(_df(spark), path)
    assert len(_rows(spark, path)) == 4


def test_a_failed_write_leaves_the_old_sets(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_artifacts(_df(spark, ("a", "index", "1"), ("b", "index", "1")), path)
    before = _rows(spark, path)
    many = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("slug"), F.col("id").cast("string").alias("name"), F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise("2").alias("body"))
    with pytest.raises(Exception, match="lost"):
        S.write_artifacts(many, path)
    assert _rows(spark, path) == before
    # written and not named: the writer died before its manifest
    _df(spark, ("a", "index", "3")).write.parquet(f"{path}/sets/artifact_set=wdead")
    assert _rows(spark, path) == before


def test_columns_may_change(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_artifacts(_df(spark, ("a", "index", "1")), path)
    S.write_artifacts(_df(spark, ("b", "index", "1")).withColumn("size", F.lit(1)), path)
    got = {r["slug"]: r["size"] for r in S.read_artifacts(spark, path).collect()}
    assert got == {"a": None, "b": 1}
