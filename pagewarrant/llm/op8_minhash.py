"""N-gram Jaccard similarity join by MinHash banding.

1. Each text becomes minimum hashes over its word n-grams, in bands; bands and
   rows are chosen for a target recall at the threshold (``band_shape``).
   Texts with the same words are one *text* from here on, with a count.
2. Band hashes that several texts share are buckets (shuffle on band hashes);
   buckets with the same members count once.
3. Buckets link texts into candidate components.  A component's texts meet in
   blocks with their full n-gram sets, which are compared exactly as matrix
   products; each block returns per text its number of links and a label, never
   pairs.  Components beyond ``COMPONENT`` texts meet by bucket instead, where a
   pair counts only in the first band that it shares.
4. Labels link texts into classes; those of a component of one block are classes already.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .components import components
from .session import bounded_batches, checkpoint, counted, few, releasing, releasing_batches

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
#: Texts of a block; a task compares two blocks.
BLOCK = 256
#: Texts of a candidate component that is compared as a whole.
COMPONENT = 16_384


def band_shape(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest false candidates) with the recall at the threshold in ``most`` hashes."""
    if threshold >= 1:
        return 1, 1
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = bands, rows
    return best


def _grams(buf, off, n: int):
    """Distinct n-gram hashes of each document; shorter ones are one gram.  Yields (row, hashes)."""
    _, _, hashes, units = H.words(buf, off, ~H.SPACE)
    grams = H.gram_hashes(hashes, n)
    for i in range(len(off) - 1):
        a, b = int(units[i]), int(units[i + 1])
        if b - a >= n:
            yield i, grams[a : b - n + 1]
        elif b > a:
            yield i, H.gram_hashes(hashes[a:b], b - a)


def _sign(n: int, bands: int, rows: int):
    factors = H.mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | H.U(1)
    schema = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches):
        for batch in batches:
            buf, off = H.column_bytes(batch.column("_k_text"))
            ids = batch.column("_k_id").to_pylist()
            for x, y in H.chunks(off, 1_000_000):
                part, at = buf[off[x] : off[y]], off[x : y + 1] - off[x]
                raw = part.tobytes()
                got = list(_grams(part, at, n))
                if not got:
                    continue
                flat = np.concatenate([g for _, g in got])
                starts = np.cumsum([0] + [len(g) for _, g in got[:-1]])
                least = np.stack([np.minimum.reduceat(flat * f, starts) for f in factors], 1)
                codes = np.zeros((len(got), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        codes = H.mix(codes * H.U(0x9E3779B97F4A7C15) + least[:, r::rows])
                keys = [_key(raw[at[i] : at[i + 1]]) for i, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()),
                        pa.array([ids[x + i] for i, _ in got], pa.int64()),
                        pa.ListArray.from_arrays(np.arange(0, codes.size + 1, bands, dtype=np.int32), pa.array(codes.ravel().view(np.int64))),
                    ],
                    schema=schema,
                )

    return sign


def _key(text: bytes) -> bytes:
    """What texts with the same words share."""
    return hashlib.md5(b" ".join(text.split())).digest()


def _sets(n: int):
    """Each text's key and its n-gram set, as sorted 64-bit hashes."""
    schema = pa.schema([("key", pa.binary()), ("grams", pa.binary())])

    def sets(batches):
        for batch in batches:
            buf, off = H.column_bytes(batch.column("_k_text"))
            for x, y in H.chunks(off, 1_000_000):
                part, at = buf[off[x] : off[y]], off[x : y + 1] - off[x]
                raw = part.tobytes()
                got = [(_key(raw[at[i] : at[i + 1]]), np.unique(g).tobytes()) for i, g in _grams(part, at, n)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*got)], schema=schema)

    return sets


def _overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of intersections of the first ``split`` sets with the others (with themselves if there are none)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left = split if split < len(sets) else len(sets)
    out = np.zeros((left, len(sets) - split if split < len(sets) else len(sets)), np.float32)
    step = 2048
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        x, y = np.searchsorted(column, [a, a + step])
        grid = np.zeros((len(sets), step), np.float32)
        grid[owner[x:y], column[x:y] - a] = 1
        out += grid[:left] @ (grid[split:] if split < len(sets) else grid).T
    return out


def _compare(threshold: float):
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("label", pa.binary()), ("alone", pa.bool_()), ("copies", pa.int64()), ("least", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        keys = [table["key"][int(i)].as_py() for i in order]
        copies = table["copies"].to_numpy()[order].astype(np.float64)
        bodies = table["grams"].combine_chunks()
        sets = [np.frombuffer(bodies[int(i)].as_py(), np.uint64) for i in order]
        cross = side.any()
        split = int((side == 0).sum()) if cross else len(sets)
        if cross and split == 0:
            return schema.empty_table()
        left, right = (slice(0, split), slice(split, len(sets))) if cross else (slice(0, len(sets)),) * 2
        sizes = np.array([len(s) for s in sets], np.float32)
        common = _overlaps(sets, split)
        linked = common >= threshold * (sizes[left, None] + sizes[None, right] - common) - 1e-4
        if not cross:
            np.fill_diagonal(linked, False)
        band = table["band"][0].as_py()
        if band is not None and band > 0:  # by bucket: not if an earlier band has the pair
            codes = np.array(table["bands"].to_pylist(), np.int64)[order]
            for b in range(band):
                linked &= codes[left, b][:, None] != codes[None, right, b]
        links = np.zeros(len(sets))
        links[left] += linked @ copies[right]
        if cross:
            links[right] += copies[left] @ linked
        # labels: the least position that links lead to
        label = np.arange(len(sets))
        while True:
            new = label.copy()
            big = len(sets)
            new[left] = np.minimum(new[left], np.where(linked, label[None, right], big).min(1, initial=big))
            if cross:
                new[right] = np.minimum(new[right], np.where(linked, label[left, None], big).min(0, initial=big))
            new = new[new]
            if (new == label).all():
                break
            label = new
        # a class goes by its least key
        ranked = sorted(range(len(sets)), key=keys.__getitem__)
        rank = np.argsort(ranked)
        first = np.full(len(sets), len(sets))
        np.minimum.at(first, label, rank)
        some = np.flatnonzero(links > 0)
        names = [keys[ranked[first[label[i]]]] for i in some]
        own = [table[c].combine_chunks().take(pa.array(order[some])) for c in ("alone", "copies", "least")]
        return pa.table([pa.array([keys[i] for i in some], pa.binary()), pa.array(links[some].astype(np.int64)), pa.array(names, pa.binary()), *own], schema=schema)

    return compare


def words_key(text: F.Column) -> F.Column:
    """``_k_text_key`` of a text as an expression: null for texts without words."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "))
    return F.when(words != "", F.unhex(F.md5(words.cast("binary"))))


def minhash_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Near-duplicate classes: ``_k_id, _k_text_key, _k_class_key, class_id, n_links`` for each row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of ``n``
    consecutive white-space words is at least ``threshold`` (a text of fewer
    words is one gram).  ``n_links`` counts the other documents linked to a
    document, ``class_id`` is the least id in its connected component
    (``_k_class_key`` tells components apart where ids repeat).
    Copies are counted, not compared.

    Null and empty texts have no grams: their class is their own id, without
    links.  A row with a null id takes no part and has a null class.  Repeated
    rows count as documents that are linked, and rows of one id with different
    texts as different documents.  An empty table gives no rows; other columns
    are not read.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_k_id"), F.col(f"`{text_col}`").alias("_k_text"))
    bands, rows = band_shape(threshold, recall)
    signed = own.where("_k_id is not null").mapInArrow(releasing_batches(_sign(n, bands, rows)), "key binary, id long, bands array<long>")
    signed = checkpoint(signed)
    texts = checkpoint(signed.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("bands").alias("bands")))

    # buckets of several texts; equal sets of members count once, in their first band
    places = texts.select("key", F.posexplode("bands").alias("band", "code"))
    shared = places.groupBy("band", "code").agg(F.count("*").alias("members"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("who"), F.min("key").alias("head")).where("members > 1")
    shared = shared.groupBy("members", "who").agg(F.min(F.struct("band", "code", "head")).alias("b")).select("b.*", "members")
    inside = checkpoint(places.join(shared, ["band", "code"]).select("key", "band", "code", "members", "head"))
    linked = components(inside.select(F.col("key").alias("a"), F.col("head").alias("b")))
    wanted = linked.join(checkpoint(linked.groupBy("component").agg(F.count("*").alias("members"))), "component").withColumnRenamed("node", "key").join(texts, "key")
    # bands are for texts that meet by bucket
    bands = F.when(F.col("members") > COMPONENT, F.col("bands")).alias("bands")
    wanted, n_wanted, largest = counted(wanted.select("key", "component", "members", "copies", "least", bands), largest=F.max("members"))

    # block pairs of components, or of buckets where a component is too large
    def blocks(df: DataFrame) -> DataFrame:
        n_blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("key", F.lit(7)), n_blocks).cast("int")
        alone = (F.col("band").isNull() & (n_blocks == 1)).alias("alone")
        df = df.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        return df.select("key", "copies", "least", "bands", "unit", "band", alone, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).cast("int").alias("side"))

    texts_of = ["key", "copies", "least", "bands"]
    whole = wanted.where(F.col("members") <= COMPONENT).select(*texts_of, F.col("component").alias("unit"), "members", F.lit(None).cast("int").alias("band"))
    tasks = blocks(whole)
    if (largest or 0) > COMPONENT:
        bucket = inside.join(wanted.where(F.col("members") > COMPONENT).select(*texts_of), "key")
        tasks = tasks.unionByName(blocks(bucket.select(*texts_of, F.encode(F.concat_ws("_", "band", "code"), "utf-8").alias("unit"), "members", "band")))

    # rows with such an id may hold other texts: their keys are told from the text and join nothing
    first = own.where("_k_id is not null").join(few(wanted.select(F.col("least").alias("_k_id")), n=n_wanted), "_k_id", "left_semi")
    sets = first.mapInArrow(releasing_batches(_sets(n)), "key binary, grams binary").dropDuplicates(["key"])
    links = tasks.join(sets, "key").groupBy("unit", "x", "y").applyInArrow(releasing(_compare(threshold)), "key binary, links long, label binary, alone boolean, copies long, least long")
    links = checkpoint(links)
    classes = components(links.where("not alone").select(F.col("key").alias("a"), F.col("label").alias("b")))

    # texts with links or copies; any other is its own class
    several = texts.where("copies > 1").select("key", F.lit(0).cast("long").alias("links"), F.lit(None).cast("binary").alias("label"), "copies", "least")
    named = links.select("key", "links", F.when(F.col("alone"), F.col("label")).alias("label"), "copies", "least").unionByName(several)
    named = named.groupBy("key").agg(F.sum("links").alias("links"), F.min("label").alias("label"), F.min("copies").alias("copies"), F.min("least").alias("least"))
    named = named.join(classes.withColumnRenamed("node", "key"), "key", "left")
    named = checkpoint(named.select("key", "least", F.coalesce("component", "label", "key").alias("class"), (F.col("links") + F.col("copies") - 1).alias("n_links")))
    smallest = checkpoint(named.groupBy("class").agg(F.min("least").alias("class_id")))
    result = named.join(smallest, "class").select("key", "class", "class_id", "n_links")
    found = signed.select("id", "key").join(result, "key", "left")
    found = found.select(
        F.col("id").alias("_k_id"), F.col("key").alias("_k_text_key"), F.coalesce("class", "key").alias("_k_class_key"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )
    # rows without grams or id
    bare = own.where(F.col("_k_id").isNull() | ~F.coalesce(F.col("_k_text"), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return found.unionByName(bare.select("_k_id", F.lit(None).cast("binary").alias("_k_text_key"), F.lit(None).cast("binary").alias("_k_class_key"), F.col("_k_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
