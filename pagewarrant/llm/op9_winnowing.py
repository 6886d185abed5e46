"""Benchmark decontamination by winnowing.

A window is ``size`` consecutive item words; an item of fewer words is one
window of its own length.  A window's fingerprint is the least hash of its
``GRAM``-word grams, so every shared span of ``size`` words shares a
fingerprint.  Fingerprints of documents meet those of the benchmark, hits are
extended to whole windows and compared by 128 bits.

While the benchmark has at most ``broadcast_windows`` windows (counted first),
its fingerprints go to all tasks and documents are scanned once, without a
shuffle; a larger benchmark is joined by shuffles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .session import bounded_batches, releasing_batches

SIZE = 13
GRAM = 5
#: Windows of a benchmark that is broadcast: 24 bytes each and the item ids.
BROADCAST_WINDOWS = 500_000
_BASES = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)


class _Spec:
    def __init__(self, size: int):
        self.size, self.gram = size, min(GRAM, size)


def _words(buf, off):
    _, _, hashes, units = H.words(H.LOWER[buf], off, H.ALNUM)
    return hashes, units


def _both(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return H.gram_hashes(hashes, n, _BASES[0]).view(np.int64), H.gram_hashes(hashes, n, _BASES[1]).view(np.int64)


def _benchmark_windows(size: int):
    spec = _Spec(size)
    schema = pa.schema([("item", pa.string()), ("length", pa.int32()), ("name", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def windows(batches):
        for batch in batches:
            buf, off = H.column_bytes(batch.column(1))
            hashes, units = _words(buf, off)
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = hashes[units[i] : units[i + 1]]
                n = min(size, len(own))
                if not n or item is None:
                    continue
                h1, h2 = _both(own, n)
                if n == size:
                    starts, ends, found = H.window_runs(spec, own, np.array([0, len(own)]))
                    name = np.repeat(found, ends - starts).view(np.int64)
                else:
                    name = h1
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(h1), pa.string()), pa.array(np.full(len(h1), n, np.int32)), pa.array(name), pa.array(h1), pa.array(h2)], schema=schema)

    return windows


def _candidates(size: int, hashes, units, known):
    """Windows that may be the benchmark's: owner, start, length, both hashes.  ``known``: names by length, or None for all."""
    out = []
    lengths = [size] if known is None else sorted(known)
    for n in lengths:
        names = None if known is None else known[n]
        if n == size:
            starts, ends, found = H.window_runs(_Spec(size), hashes, units)
            if names is not None:
                hit = H.member(found, names)
                starts, ends = starts[hit], ends[hit]
            if not len(starts):
                continue
            count = ends - starts
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
            h1, h2 = _both(hashes, n)
        else:
            h1, h2 = _both(hashes, n)
            at = np.flatnonzero(H.member(h1.view(np.uint64), names)) if names is not None else np.arange(len(h1))
        if not len(at):
            continue
        owner = np.searchsorted(units, at, "right") - 1
        inside = at + n <= units[owner + 1]
        at, owner = at[inside], owner[inside]
        out.append((owner, at - units[owner], np.full(len(at), n), h1[at], h2[at]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 5


_RESULT = T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType()))


def _covered(owner, start, length, units) -> np.ndarray:
    """Words of each document inside any of the windows."""
    change = np.zeros(int(units[-1]) + 1, np.int64)
    np.add.at(change, start + units[owner], 1)
    np.add.at(change, start + units[owner] + length, -1)
    total = np.r_[0, np.cumsum(np.cumsum(change)[:-1] > 0)]
    return total[units[1:]] - total[units[:-1]]


def _scan(size: int, shared):
    """One pass over documents against a broadcast benchmark; keeps the columns it gets, replaces the text."""

    def scan(batches):
        known, windows = shared.value
        for batch in batches:
            buf, off = H.column_bytes(batch.column("_k_text"))
            n_words, n_hit, items = [], [], []
            for a, b in H.chunks(off):
                hashes, units = _words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                owner, start, length, h1, h2 = _candidates(size, hashes, units, known)
                found = [windows.get(k) for k in zip(length.tolist(), h1.tolist(), h2.tolist())]
                good = np.array([x is not None for x in found], bool)
                sets = [set() for _ in range(b - a)]
                for i, x in zip(owner.tolist(), found):
                    if x is not None:
                        sets[i].update(x)
                n_words.append(np.diff(units))
                n_hit.append(_covered(owner[good], start[good], length[good], units))
                items += [sorted(x) for x in sets]
            none = [np.empty(0, np.int64)]
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_k_text"]
            names = [n for n in batch.schema.names if n != "_k_text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.concatenate(n_words or none)), pa.array(np.concatenate(n_hit or none).astype(np.int64)), pa.array(items, pa.list_(pa.string()))], [*names, "n_words", "n_hit", "items"]
            )

    return scan


def _fingerprints(size: int, lengths: list[int]):
    """Per document one row of counts (name null), and a row for each run of windows of one fingerprint."""
    schema = pa.schema([("key", pa.binary()), ("n_words", pa.int64()), ("name", pa.int64()), ("length", pa.int32()), ("start", pa.int64()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64()))])

    def fingerprints(batches):
        for batch in batches:
            buf, off = H.column_bytes(batch.column("_k_text"))
            raw = buf.tobytes()
            for a, b in H.chunks(off, 500_000):
                hashes, units = _words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                keys = [hashlib.md5(raw[off[i] : off[i + 1]]).digest() for i in range(a, b)]
                rows = [(k, n, None, None, None, None, None) for k, n in zip(keys, np.diff(units).tolist())]
                for n in lengths:
                    h1, h2 = _both(hashes, n)
                    if n == size:
                        starts, ends, found = H.window_runs(_Spec(size), hashes, units)
                        owner = np.searchsorted(units, starts, "right") - 1
                        runs = zip(owner.tolist(), starts.tolist(), ends.tolist(), found.view(np.int64).tolist())
                    else:
                        at = np.arange(len(h1))
                        owner = np.searchsorted(units, at, "right") - 1
                        at, owner = at[at + n <= units[owner + 1]], owner[at + n <= units[owner + 1]]
                        runs = zip(owner.tolist(), at.tolist(), (at + 1).tolist(), h1[at].tolist())
                    rows += [(keys[i], None, name, n, s - int(units[i]), h1[s:e].tolist(), h2[s:e].tolist()) for i, s, e, name in runs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return fingerprints


def _by_shuffle(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Results by text (128-bit key): equal texts have equal results, so each is matched once."""
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most ``size`` numbers
    rows = docs.select("_k_text").mapInArrow(_fingerprints(size, lengths), "key binary, n_words long, name long, length int, start long, h1 array<long>, h2 array<long>")
    hits = (
        rows.where("name is not null")
        .dropDuplicates(["key", "length", "start"])
        .join(windows.select("name", "length").distinct(), ["name", "length"], "left_semi")
        .select("key", "length", "start", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "w"))
        .select("key", "length", (F.col("start") + F.col("i")).alias("at"), "w.h1", "w.h2")
        .join(windows.select("item", "length", "h1", "h2").distinct(), ["length", "h1", "h2"])
    )
    # merge spans in order: (words covered, end so far)
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["at"], s["end"]), F.lit(0).cast("long"))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")),
    )
    by_doc = hits.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("end"))).alias("spans"))
    by_doc = by_doc.select("key", "items", merged["n"].alias("n_hit"))
    counts = rows.where("n_words is not null").groupBy("key").agg(F.max("n_words").alias("n_words"))
    return counts.join(by_doc, "key", "left")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SIZE,
    share: int = 20,
    broadcast_windows: int = BROADCAST_WINDOWS,
    with_text: bool = False,
) -> DataFrame:
    """Words of each document inside occurrences of benchmark windows.

    Words are runs of ``[0-9a-z]`` and non-ASCII after A-Z are lower-cased.
    Returns one row per row of ``docs``: ``_k_id``, ``_k_row`` (struct of its
    other columns), ``n_words``, ``n_hit`` (words hit), ``items`` (ids, as
    strings in order, of items with occurring windows) and ``contaminated``
    (``n_hit > 0 and share * n_hit >= n_words``).

    Null or empty texts have no words and are clean.  Items with a null id or
    without words take no part; equal windows of several items count for each;
    repeated rows each get their result; an empty benchmark leaves all clean.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    own = docs.select(F.col(f"`{id_col}`").alias("_k_id"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_k_row"), F.col(f"`{text_col}`").alias("_k_text"))
    if with_text:
        own = own.withColumn("_k_kept_text", F.col("_k_text"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    windows = items.mapInArrow(_benchmark_windows(size), "item string, length int, name long, h1 long, h2 long")
    few = windows.limit(broadcast_windows + 1).count() <= broadcast_windows if broadcast_windows else False
    if few:
        names: dict[int, set] = {}
        lookup: dict[tuple, list] = {}
        for r in windows.toLocalIterator():
            names.setdefault(r["length"], set()).add(r["name"])
            lookup.setdefault((r["length"], r["h1"], r["h2"]), []).append(r["item"])
        known = {n: np.sort(np.array(list(x), np.int64).view(np.uint64)) for n, x in names.items()}
        shared = docs.sparkSession.sparkContext.broadcast((known, {k: tuple(dict.fromkeys(v)) for k, v in lookup.items()}))
        schema = T.StructType([f for f in own.schema if f.name != "_k_text"] + _RESULT.fields)
        out = own.mapInArrow(releasing_batches(_scan(size, shared)), schema)
    else:
        found = _by_shuffle(own, windows, size)
        key = F.unhex(F.md5(F.coalesce(F.col("_k_text"), F.lit("")).cast("binary")))
        out = own.withColumn("key", key).join(found, "key", "left").drop("key", "_k_text")
        out = out.withColumns({"n_words": F.coalesce("n_words", F.lit(0).cast("long")), "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
