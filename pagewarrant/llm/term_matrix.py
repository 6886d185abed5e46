"""A sparse document-term matrix in CSR shards whose columns are words of one dictionary.

Texts are cut into words once: a task turns its rows into shards of bounded size
with word numbers of their own.  The words of all shards meet by word, get dense
numbers (a rank within their bucket after the words of all buckets before), and
the numbers go back to the shards, which are renumbered.  A word costs a shard one
row however often it occurs there, so a frequent word costs a row per shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import bounded_batches, partitions, release, releasing_two, stored

#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD_BYTES = 32 << 20
_PARTS = ("indptr", "indices", "counts")


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed."""
    raw = values.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def unpack(data: bytes) -> np.ndarray:
    """The numbers that ``pack`` has packed."""
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), "<u4").astype(np.int64) if data else np.zeros(0, np.int64)


def _shard(number: int, rows: list[pa.RecordBatch], texts: list[pa.Array]) -> pa.RecordBatch:
    split = pc.ascii_split_whitespace(pa.concat_arrays(texts))  # at space, \t, \n, \v, \f and \r
    words, starts = split.values, split.offsets.to_numpy()
    there = pc.not_equal(pc.binary_length(words), 0)  # what lies outside leading and trailing white space
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[there.to_numpy(zero_copy_only=False)]
    coded = words.filter(there).dictionary_encode()
    n = max(1, len(coded.dictionary))
    cells, counts = np.unique(row * n + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    indptr = np.searchsorted(cells // n, np.arange(len(starts)))
    kept = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    kept = pa.StructArray.from_arrays([kept.column(i) for i in range(kept.num_columns)], fields=list(kept.schema))
    packed = [pa.array([pack(x)]) for x in (indptr, cells % n, counts)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(kept), *packed, one(coded.dictionary.cast(pa.binary()))], ["shard", "rows", *_PARTS, "words"])


def _local(shard_bytes: int):
    def local(batches):
        number, size, rows, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            text = batch.column("_k_text").fill_null("")
            kept = batch.select([n for n in batch.schema.names if n != "_k_text"])
            ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                # rows that still fit, one at least in an empty shard
                stop = max(int(np.searchsorted(ends, before + shard_bytes - size, "right")), start + (not texts))
                if stop > start:
                    rows.append(kept.slice(start, stop - start))
                    texts.append(text.slice(start, stop - start))
                    size += int(ends[stop - 1] - before)
                if stop < len(ends):
                    yield _shard(number, rows, texts)
                    number, size, rows, texts = number + 1, 0, [], []
                start = stop
        if texts:
            yield _shard(number, rows, texts)
        release()

    return local


def local_shards(docs: DataFrame, text: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``shard, rows, indptr, indices, counts, words``, stored: rows of ``docs`` without their text, and their words numbered within the shard."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    read = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_k_text"))
    rows = T.ArrayType(T.StructType([docs.schema[c] for c in kept]))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("rows", rows), *[T.StructField(n, T.BinaryType()) for n in _PARTS], T.StructField("words", T.ArrayType(T.BinaryType()))])
    return stored(read.mapInArrow(_local(shard_bytes), schema), "term-shards")


def numbered_words(shards: DataFrame) -> DataFrame:
    """``shard, local, word, id``: the words of each shard with their number there and in the dictionary, which counts all distinct words from 0 without gaps."""
    own = shards.select("shard", F.posexplode("words").alias("local", "word"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(partitions(shards.sparkSession, 4))).cast("int")
    ranked = own.withColumn("bucket", bucket).withColumn("rank", F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")))
    ranked = stored(ranked, "term-words")
    first, bases = 0, []
    for r in ranked.groupBy("bucket").agg(F.max("rank").alias("n")).orderBy("bucket").collect():  # a row for each bucket
        bases.append((r["bucket"], first))
        first += r["n"]
    base = F.broadcast(shards.sparkSession.createDataFrame(bases, "bucket int, base long"))
    return ranked.join(base, "bucket").select("shard", "local", "word", (F.col("base") + F.col("rank") - 1).alias("id"))


def dictionary(words: DataFrame) -> DataFrame:
    """``word, id`` of numbered words."""
    return words.select("word", "id").distinct()


def csr(indptr: np.ndarray, indices: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's matrix with dictionary numbers as columns, each row's in order."""
    columns = ids[indices]
    row = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    order = np.lexsort((columns, row))
    return indptr, columns[order], counts[order]


def row_measures(indptr: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the entries of each row."""
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return total[indptr[1:]] - total[indptr[:-1]], np.diff(indptr).astype(np.int64)


def matrix(shard: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matrix of one shard row and its numbered words."""
    ids = np.zeros(len(words), np.int64)
    ids[words["local"].to_numpy()] = words["id"].to_numpy()
    return csr(*[unpack(shard[n][0].as_py()) for n in _PARTS], ids)


def _measure(shard: pa.Table, words: pa.Table) -> pa.Table:
    n_words, n_distinct = row_measures(*matrix(shard, words))
    rows = shard["rows"].combine_chunks().flatten()
    return pa.table([*rows.flatten(), pa.array(n_words), pa.array(n_distinct)], [*[f.name for f in rows.type], "n_words", "n_distinct"])


def word_measures(docs: DataFrame, text: str) -> DataFrame:
    """Rows of ``docs`` without their text, with ``n_words`` and ``n_distinct``: sum and number of the entries of their matrix row.

    A null text is empty; a table without rows gives none.
    """
    shards = local_shards(docs, text)
    words = numbered_words(shards).select("shard", "local", "id")
    schema = T.StructType([*shards.schema["rows"].dataType.elementType.fields, T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())])
    return shards.drop("words").groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(releasing_two(_measure), schema)
