"""Images and the texts that describe them: metadata groups, pictures and plain images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pages as P

# Metadata that opens a group of images, and that describes the images of a group.
GROUP_ROOTS = ["og:image", "twitter:image"]
GROUP_TEXTS = ["og:image:alt", "twitter:image:alt"]


def meta_images(nodes: DataFrame) -> DataFrame:
    """Image metadata by group: page_id, node_id, family (og or twitter), group_id, role (url or alt), value.

    A root opens the next group of its family, even without a value; what comes before any root is group 0.
    """
    name = F.lower(F.coalesce(F.nullif(P.attr("property"), F.lit("")), P.attr("name")))
    own = nodes.where("tag = 'meta'").withColumn("name", name).where(F.col("name").isin([*P.META_IMAGE, *GROUP_TEXTS]))
    line = Window.partitionBy("page_id", "family").orderBy("node_id")
    grouped = own.withColumn("family", F.substring_index("name", ":", 1)).withColumn("group_id", F.sum(F.col("name").isin(GROUP_ROOTS).cast("int")).over(line))
    role = F.when(F.col("name").isin(GROUP_TEXTS), "alt").otherwise("url")
    return grouped.select("page_id", "node_id", "family", "group_id", role.alias("role"), F.trim(P.attr("content")).alias("value")).where("value <> ''")


def meta_image_texts(nodes: DataFrame) -> DataFrame:
    """Metadata images with the texts that follow them in their group: page_id, url, alt."""
    rows = meta_images(nodes)
    urls = rows.where("role = 'url'").select("page_id", "family", "group_id", F.col("node_id").alias("at"), F.col("value").alias("url"))
    texts = rows.where("role = 'alt'").select("page_id", "family", "group_id", "node_id", F.col("value").alias("alt"))
    return urls.join(texts, ["page_id", "family", "group_id"]).where("at < node_id").select("page_id", "url", "alt").distinct()


def _candidates(nodes: DataFrame) -> DataFrame:
    """URLs that an image or a source names itself: page_id, node_id, url."""
    srcset = F.transform(F.filter(F.split(F.coalesce(P.attr("srcset"), F.lit("")), r",\s+|,$"), lambda c: F.trim(c) != ""), lambda c: F.element_at(F.split(F.trim(c), r"\s+"), 1))
    direct = F.array_compact(F.array(*[F.when(F.col("tag") == "img", F.nullif(F.trim(P.attr(a)), F.lit(""))) for a in P.IMAGE_ATTRIBUTES]))
    return nodes.select("page_id", "node_id", F.explode(F.array_distinct(F.concat(direct, srcset))).alias("url"))


def element_image_texts(nodes: DataFrame) -> DataFrame:
    """Images with their alternative text, also for the sources that stand directly in the innermost picture around them: page_id, url, alt."""
    own = P.semantic(nodes).where("not ignored and kind = 'el'")
    described = own.where((F.col("tag") == "img") & (F.trim(P.attr("alt")) != ""))
    around = F.slice("path", 1, F.size("ancestors"))
    from_end = F.array_position(F.reverse(around), "picture")
    texts = described.select("page_id", "node_id", P.attr("alt").alias("alt"), F.when(from_end > 0, F.get("ancestors", (F.size("ancestors") - from_end).cast("int"))).alias("picture"))
    plain = _candidates(described).join(texts, ["page_id", "node_id"]).select("page_id", "url", "alt")
    sources = own.where("tag = 'source'")
    inside = _candidates(sources).join(sources.select("page_id", "node_id", F.col("parent_id").alias("picture")), ["page_id", "node_id"])
    return plain.unionByName(inside.join(texts.select("page_id", "picture", "alt"), ["page_id", "picture"]).select("page_id", "url", "alt")).distinct()


def image_texts(nodes: DataFrame) -> DataFrame:
    """All images of a page with texts that describe them: page_id, url, alt."""
    return meta_image_texts(nodes).unionByName(element_image_texts(nodes)).distinct()
