"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLE_SQL as ORACLE_SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _length(spans: str) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op1_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_de_bruijn import de_bruijn_dedup

    out = de_bruijn_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("_k_id").alias("doc_id"), F.col("n_units").alias("n_words"), _length("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op2_language_id import identify

    return identify(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("_k_id", "doc_id")


def op3_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_site_bayes import quality

    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).withColumnRenamed("_k_id", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_toxicity import toxicity

    out = toxicity(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return out.select(F.col("_k_id").alias("doc_id"), "held_out", "score", "predicted")


def op5_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op5_packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("_k_id", "doc_id")


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_posting_lists import nearest

    vectors = _read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op7_lstm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_lstm_blocks import extract_main

    out = extract_main(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select(F.col("_k_id").alias("page_id"), F.col("_k_row.url").alias("url"), F.col("_k_main").alias("text"), F.length("_k_main").cast("long").alias("n_chars"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_minhash import minhash_join

    return minhash_join(_read(spark, sf_dir, "documents")).select(F.col("_k_id").alias("doc_id"), "class_id", "n_links")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_winnowing import decontaminate

    out = decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("_k_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_suffix_array import suffix_array_dedup

    out = suffix_array_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("_k_id").alias("doc_id"),
        F.col("n_units").alias("n_bytes"),
        _length("removed").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op11_warc import read_warc, write_warc
    from .session import shared_folder

    folder = shared_folder(spark, "warc")
    write_warc(_read(spark, sf_dir, "pages"), folder)
    records = read_warc(spark, folder).where("warc_type in ('response', 'revisit')")
    return records.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_filter_audit import filter_audit

    return filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_de_bruijn": op1_de_bruijn,
    "op2_language_id": op2_language_id,
    "op3_site_bayes": op3_site_bayes,
    "op4_toxicity": op4_toxicity,
    "op5_shortest_pack": op5_shortest_pack,
    "op6_posting_lists": op6_posting_lists,
    "op7_lstm_blocks": op7_lstm_blocks,
    "op8_minhash": op8_minhash,
    "op9_winnowing": op9_winnowing,
    "op10_suffix_array": op10_suffix_array,
    "op11_warc": op11_warc,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}
