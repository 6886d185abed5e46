"""Text, JSON-lines and Markdown sources, artifact sinks and receipts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

_LINES = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85]"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: file, line (from 1), text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", _LINES).alias("lines"))
    # a final line end starts no line
    kept = F.when(F.element_at("lines", -1) == "", F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines"))
    return files.select("file", F.posexplode(kept).alias("i", "text")).select("file", (F.col("i") + 1).alias("line"), "text")


def parse_json_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects (file, line, row variant) and errors (file, line, rule_id) of non-blank lines."""
    rows = lines.where(F.trim("text") != "").withColumn("row", F.try_parse_json("text"))
    is_object = F.schema_of_variant("row").startswith("OBJECT")
    good = rows.where(F.col("row").isNotNull() & is_object).select("file", "line", "text", "row")
    bad = rows.where(F.col("row").isNull() | ~is_object).select("file", "line", F.when(F.col("row").isNull(), "invalid_json").otherwise("not_an_object").alias("rule_id"))
    return good, bad


def recover_json(text: Column) -> Column:
    """The JSON object in chatty or fenced text, as a variant: from the first brace to the last; null if none parses."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)))


def md_sections(lines: DataFrame, level: int = 2) -> DataFrame:
    """Sections under headings of a level: file, ord, heading, body."""
    mark = "#" * level + " "
    heads = lines.withColumn("is_head", F.col("text").startswith(mark))
    numbered = heads.withColumn("ord", F.sum(F.col("is_head").cast("int")).over(Window.partitionBy("file").orderBy("line"))).where("ord > 0")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_head"), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    return numbered.groupBy("file", "ord").agg(F.max(F.when(F.col("is_head"), F.substring("text", len(mark) + 1, 1_000_000))).alias("heading"), body.alias("body"))


def md_tags(lines: DataFrame, pattern: str) -> DataFrame:
    """Distinct first groups of a pattern over lines: file, tag."""
    return lines.select("file", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("tag")).distinct()


#: Lines of a router table and headings of frames that hold a tag.
ROUTER_TAG, FRAME_TAG = r"^\| `([^`]+)` \|", r"^## `([^`]+)`"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file, with the file's path."""
    return spark.read.option("multiLine", True).schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("file"))


def manifest_fields(files: DataFrame, col: str = "value") -> DataFrame:
    """Fields of manifests: file, field, value (JSON text), source, verify_against."""
    kind = "struct<fields: map<string, struct<value: variant, source: string, verify_against: array<string>>>>"
    each = files.select("file", F.explode(F.from_json(col, kind)["fields"]).alias("field", "f"))
    return each.select("file", "field", F.to_json("f.value").alias("value"), "f.source", "f.verify_against")


def with_receipt(df: DataFrame, col: str) -> DataFrame:
    """Adds size, digest and payload of an artifact."""
    body = F.col(col).cast("binary")
    return df.withColumns({"size_bytes": F.octet_length(body), "sha256": F.sha2(body, 256), "payload": F.base64(body)})


def check_receipt(df: DataFrame, col: str, size: str = "size_bytes", digest: str = "sha256") -> DataFrame:
    """Rows whose declared size or digest is not that of the artifact."""
    body = F.col(col).cast("binary")
    return df.where(~(F.octet_length(body).eqNullSafe(F.col(size)) & F.sha2(body, 256).eqNullSafe(F.lower(digest))))


def write_artifacts(df: DataFrame, path: str) -> None:
    """File sets by ``slug``, each replaced whole or not at all; columns other than ``slug`` are the files.

    A set is staged in a folder of its own; once that is written, one append to the manifest names it as the last of its
    slugs.  Spark commits an append as a whole, so a write that fails at any point leaves all sets as they were, and readers
    (``read_artifacts``) never see parts of one.  Rows without a slug take no part; no column may be called ``artifact_set``.  Of two writers at once the later one
    counts, for each slug whole.
    """
    spark, name = df.sparkSession, "w" + uuid.uuid4().hex
    sets = df.where("slug is not null")
    sets.write.parquet(f"{path}/sets/artifact_set={name}")
    staged = spark.read.schema(sets.schema).parquet(f"{path}/sets/artifact_set={name}")
    named = staged.select("slug").distinct().select("slug", F.lit(name).alias("artifact_set"), F.current_timestamp().alias("written"))
    named.write.mode("append").parquet(f"{path}/manifest")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """The last whole set of each slug; staged sets that no manifest names are not read.

    Sets are a partition of the table, so the join with the manifest prunes those that count no more.
    """
    last = spark.read.parquet(f"{path}/manifest").groupBy("slug").agg(F.max(F.struct("written", "artifact_set"))["artifact_set"].alias("artifact_set"))
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/sets")
    return rows.join(last, ["slug", "artifact_set"], "left_semi").drop("artifact_set")


def image_manifest(images: DataFrame, id_col: str, url: str = "url", order: str = "ord", context: str = "context") -> DataFrame:
    """Numbers http images of a document within their context and names their files: id, url, file."""
    web = images.where(F.col(url).rlike("^(?i)https?://"))
    n = F.row_number().over(Window.partitionBy(id_col, context).orderBy(order)) - 1
    ext = F.substring(F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)), F.lit("")), F.lit("jpg")), 1, 4)
    return web.select(id_col, url, F.concat(F.coalesce(context, F.lit("image")), F.lit("_"), n, F.lit("."), ext).alias("file"))


def site_slug(url: Column) -> Column:
    """Slug of a URL's host without www."""
    return X.slugify(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"^(?i)www\.", ""))
