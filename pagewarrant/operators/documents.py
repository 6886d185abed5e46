"""Extracted site documents: enrichment queues, merging, contracts and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def enrichment_queue(pages_to_fetch: DataFrame, allowed: list[str], most: int = 2) -> DataFrame:
    """Pages worth fetching: of each type the lowest priority, ties by position.

    ``pages_to_fetch`` has doc_id, pos, page_type, url, priority, fetchable.
    """
    own = pages_to_fetch.where(F.col("fetchable") & (F.col("priority") <= most) & F.col("page_type").isin(allowed))
    n = F.row_number().over(Window.partitionBy("doc_id", "page_type").orderBy("priority", "pos"))
    return own.withColumn("n", n).where("n = 1").drop("n")


def on_site(queue: DataFrame, fetched: DataFrame) -> DataFrame:
    """Queue rows whose fetched URL (doc_id, page_type, final_url) stayed on the site (``site_url``)."""
    return queue.join(fetched, ["doc_id", "page_type"]).where(X.same_origin(F.col("site_url"), F.col("final_url")))


def merge_enrichment(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their first contact chunk and, in order, the chunks that have items.

    ``chunks`` has doc_id, pos, page_type, n_items, body (contact: page_type "contact").
    """
    contact = F.min_by(F.when(F.col("page_type") == "contact", F.col("body")), F.when(F.col("page_type") == "contact", F.col("pos")))
    others = F.sort_array(F.collect_list(F.when((F.col("page_type") != "contact") & (F.col("n_items") > 0), F.struct("pos", "body"))))
    by = chunks.groupBy("doc_id").agg(contact.alias("contact"), F.transform(others, lambda x: x["body"]).alias("sections"))
    return docs.join(by, "doc_id", "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<string>")))


def contract_values(*sources: DataFrame) -> DataFrame:
    """First-seen distinct values of several places, in their order: doc_id, kind, value, ord."""
    every = None
    for k, s in enumerate(sources):
        own = s.where(F.trim(F.coalesce("value", F.lit(""))) != "").select("doc_id", "kind", F.trim("value").alias("value"), (F.lit(k).cast("long") * (1 << 32) + F.coalesce(F.col("ord") if "ord" in s.columns else F.lit(0), F.lit(0))).alias("at"))
        every = own if every is None else every.unionByName(own)
    first = every.groupBy("doc_id", "kind", "value").agg(F.min("at").alias("at"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("at", "value"))).drop("at")


def is_hex(color: Column) -> Column:
    return F.coalesce(color.rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))


def first_color(*colors: Column) -> Column:
    """The first six-digit colour, upper case."""
    return F.upper(F.coalesce(*[F.when(is_hex(c), c) for c in colors]))


def darken(color: Column, by: float = 0.75) -> Column:
    """A colour with each channel scaled down."""
    part = lambda k: F.lpad(F.hex(F.floor(F.conv(F.substring(color, k, 2), 16, 10).cast("int") * by).cast("long")), 2, "0")
    return F.when(is_hex(color), F.concat(F.lit("#"), part(2), part(4), part(6)))


def platform_cost(monthly: Column) -> tuple[Column, Column]:
    """Annual cost of a platform and five years' saving against 75 once."""
    return monthly * 12, monthly * 12 * 5 - 75


def remaining_pages(pages_to_fetch: DataFrame, fetched: DataFrame, most: int = 2) -> DataFrame:
    """Labels of wanted pages that were not fetched, in order: doc_id, labels."""
    left = pages_to_fetch.where(F.col("priority") <= most).join(fetched.select("doc_id", "url"), ["doc_id", "url"], "left_anti")
    return left.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), ", ").alias("labels"))


def needs_hero(images: Column, prompt: Column) -> Column:
    """Whether a document asks for a hero image: a prompt, or no hero or background among its images."""
    return (F.trim(F.coalesce(prompt, F.lit(""))) != "") | ~F.exists(F.coalesce(images, F.array().cast("array<struct<context:string>>")), lambda i: i["context"].isin("hero", "background"))


def contact_page(pages_to_fetch: DataFrame) -> DataFrame:
    return pages_to_fetch.where("page_type = 'contact'").groupBy("doc_id").agg(F.min_by("url", "pos").alias("contact_url"))
