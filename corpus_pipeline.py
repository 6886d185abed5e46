"""Corpus pipeline: five operators in a row over documents.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return
the columns of documents, of any names and types.  A row with a null id is
judged by its text where a text is judged (toxicity, contamination); no id is
smaller or larger than none, so no near copy or repeat is taken from it.
Rows of one id are judged each by its own text.  Null and empty texts stay in
every stage, very long ones are read whole, empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarrant.llm.op4_toxicity import toxicity
from pagewarrant.llm.op5_packing import pack
from pagewarrant.llm.op8_minhash import minhash_join, words_key
from pagewarrant.llm.op9_winnowing import decontaminate
from pagewarrant.llm.op10_suffix_array import suffix_array_dedup
from pagewarrant.llm.session import checkpoint, few


def _columns(scored: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The documents' columns again, in their order."""
    return scored.select(*[F.col(text).alias("text") if c == "text" else F.col(f"_k_row.`{c}`").alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; rows alike in text go or stay together."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), with_text=True)
    return _columns(scored.where("predicted = 0"), "_k_kept_text", docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays: the least id's, of several texts of that id the one with the least key.

    Rows of one id are judged each by its own text; of rows alike in id and words the least stays.  Rows without words stay.
    """
    found = checkpoint(minhash_join(docs).where("_k_text_key is not null").select(F.col("_k_id").alias("doc_id"), F.col("_k_text_key").alias("_k_key"), "_k_class_key", "class_id"))
    keep = found.where("doc_id = class_id").groupBy("_k_class_key").agg(F.min("_k_key").alias("_k_key"), F.min("doc_id").alias("doc_id")).drop("_k_class_key")
    again = few(checkpoint(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")))
    gone = few(checkpoint(found.join(keep, "doc_id", "left_anti").select("doc_id").distinct()))
    once = docs.join(again, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(docs.columns)
    # ids of several rows, text by text; the documents' own columns stay apart from ours
    rows = docs.join(again, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_k_row"))
    rows = rows.select("_k_row", F.col("_k_row.doc_id").alias("doc_id"), words_key(F.col("_k_row.text")).alias("_k_key"))
    worded = rows.where("_k_key is not null").groupBy("doc_id", "_k_key").agg(F.min_by("_k_row", F.to_json("_k_row")).alias("_k_row"))
    worded = worded.join(keep, ["doc_id", "_k_key"], "left_semi").unionByName(rows.where("_k_key is null").select(worded.columns))
    return once.unionByName(worded.select("_k_row.*").select(docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document with a smaller id has go; no document goes, n_chars is counted anew."""
    cut = suffix_array_dedup(docs, with_text=True)
    out = _columns(cut, "kept_text", docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go; those without words stay."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_text=True)
    return _columns(found.where("not contaminated"), "_k_kept_text", docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("_k_id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Tokens and a trained classifier have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each one's result is stored in the checkpoint folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
