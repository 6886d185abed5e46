"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced bisection of a bounded sample.  A vector goes to
its nearest list and, near a boundary, to further lists whose centroid is nearly
as near (``CLOSURE``) and not hidden behind one that is taken already.  Centroids
are searched through an in-memory neighbour graph by best-first search.  A query
reads the lists whose centroid distance is within a ratio of its nearest
(``REACH``), at least ``LEAST_LISTS`` and until they hold enough vectors.

All vectors are indexed, equal rows once.  A list with more than ``BLOCK``
entries or queries is read in blocks of both, each with its own best ids, so no
list outgrows a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpoint, sampled

#: Vectors that the centroids are fitted on at most, and vectors of the sample behind each centroid.
SAMPLE, PER_CENTROID = 16_384, 24
DEGREE, BEAM, ENTRIES = 16, 64, 8
CLOSURE, COPIES, HIDDEN = 1.25, 4, 0.45
REACH, LEAST_LISTS = 1.17, 24
#: Lists that a query searches the graph for; where those are not all in reach, all centroids are put in order.
FIRST_LISTS = 192
BLOCK = 8192


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def bisect(sample: np.ndarray, most: int, seed: int = 0) -> np.ndarray:
    """Centroids of equally large parts: each part is halved along the line between its two means."""
    rng, parts, done = np.random.default_rng(seed), [sample], []
    while parts:
        part = parts.pop()
        if len(part) <= most or (part == part[0]).all():
            done.append(part.mean(0))
            continue
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(4):
            side = part @ (b - a)
            upper = side > np.median(side)
            if upper.all() or not upper.any():
                break
            a, b = part[~upper].mean(0), part[upper].mean(0)
        order = np.argsort(part @ (b - a), kind="stable")
        parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return np.array(done)


class CentroidGraph:
    """Centroids with their nearest others, searched from a few entries."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, n = centroids, len(centroids)
        self.norms = (centroids**2).sum(1)
        near = []
        for a in range(0, n, 512):
            d = _distances(centroids[a : a + 512], centroids)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near.append(np.argsort(d, 1, kind="stable")[:, : min(DEGREE, n - 1)])
        self.near = np.concatenate(near) if n > 1 else np.zeros((n, 0), int)
        # far-apart entries reach every part of the graph
        entry = [int(np.argmin(_distances(centroids.mean(0)[None], centroids)[0]))]
        reach = _distances(centroids[entry], centroids)[0]
        while len(entry) < min(ENTRIES * 4, n):
            entry.append(int(reach.argmax()))
            reach = np.minimum(reach, _distances(centroids[entry[-1:]], centroids)[0])
        self.entry = np.array(entry)

    def search(self, vectors: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector about its ``want`` nearest centroids, nearest first, and their distances (inf: none)."""
        n, beam = len(vectors), max(BEAM, want)
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf)
        open_ = np.zeros((n, beam), bool)
        first = np.broadcast_to(self.entry, (n, len(self.entry)))
        self._merge(vectors, np.arange(n), first, ids, dist, open_)
        while True:
            rows = np.flatnonzero(open_.any(1))
            if not len(rows):
                return ids[:, :want], dist[:, :want]
            # open the nearest unopened ones of each vector
            order = np.argsort(np.where(open_[rows], dist[rows], np.inf), 1, kind="stable")[:, :4]
            valid = np.take_along_axis(open_[rows], order, 1)
            picked = np.take_along_axis(ids[rows], order, 1)
            open_[rows[:, None], order] = False
            found = np.where(valid[:, :, None], self.near[np.maximum(picked, 0)], -1).reshape(len(rows), -1)
            self._merge(vectors, rows, found, ids, dist, open_)

    def _merge(self, vectors, rows, found, ids, dist, open_) -> None:
        for a in range(0, len(rows), 1024):
            r, f = rows[a : a + 1024], np.sort(found[a : a + 1024], 1)
            f = np.where(np.r_["1", np.zeros((len(f), 1), bool), f[:, 1:] == f[:, :-1]], -1, f)
            known = (f[:, :, None] == ids[r][:, None, :]).any(2) if ids.shape[1] else np.zeros(f.shape, bool)
            f = np.where(known, -1, f)
            v = vectors[r]
            d = (v**2).sum(1)[:, None] + self.norms[np.maximum(f, 0)] - 2 * np.einsum("nd,nkd->nk", v, self.centroids[np.maximum(f, 0)])
            d = np.where(f >= 0, np.sqrt(np.maximum(d, 0)), np.inf)
            all_d, all_i = np.concatenate([dist[r], d], 1), np.concatenate([ids[r], f], 1)
            all_o = np.concatenate([open_[r], f >= 0], 1)
            order = np.argsort(all_d, 1, kind="stable")[:, : ids.shape[1]]
            dist[r], ids[r], open_[r] = (np.take_along_axis(x, order, 1) for x in (all_d, all_i, all_o))
            open_[r] &= np.isfinite(dist[r])


def _matrix(column) -> np.ndarray:
    """Rows of equally long lists."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _post(graph: CentroidGraph):
    def post(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                v = _matrix(part.column("v"))
                ids, dist = graph.search(v, 2 * COPIES)
                taken = np.zeros(ids.shape, bool)
                taken[:, 0] = True
                for k in range(1, ids.shape[1]):
                    # not where a list already taken is nearer to this centroid than the vector is
                    between = np.sqrt(((graph.centroids[np.maximum(ids[:, :k], 0)] - graph.centroids[np.maximum(ids[:, k : k + 1], 0)]) ** 2).sum(2))
                    hidden = (taken[:, :k] & (between < HIDDEN * dist[:, k : k + 1])).any(1)
                    taken[:, k] = np.isfinite(dist[:, k]) & (dist[:, k] <= CLOSURE * dist[:, 0]) & ~hidden & (taken[:, :k].sum(1) < COPIES)
                row, col = np.nonzero(taken)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), pa.array(col == 0), part.column("id").take(pa.array(row)), part.column("v").take(pa.array(row))], ["list", "first", "id", "v"])

    return post


def _route(graph: CentroidGraph, sizes: np.ndarray, want: int):
    """Lists that a query reads."""

    def route(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                v = _matrix(part.column("v"))
                ids, dist = graph.search(v, FIRST_LISTS)
                held = np.cumsum(np.where(ids >= 0, sizes[np.maximum(ids, 0)], 0), 1)
                short = (held[:, -1] < want) | (dist[:, -1] <= REACH * dist[:, 0])
                if short.any():  # too few vectors in the lists found, or further ones in reach: all lists, in order
                    d = _distances(v[short], graph.centroids)
                    width = max(ids.shape[1], d.shape[1])
                    order = np.argsort(d, 1, kind="stable")
                    wide_i, wide_d = np.full((len(v), width), -1), np.full((len(v), width), np.inf)
                    wide_i[:, : ids.shape[1]], wide_d[:, : ids.shape[1]] = ids, dist
                    wide_i[short, : d.shape[1]], wide_d[short, : d.shape[1]] = order, np.take_along_axis(d, order, 1)
                    ids, dist = wide_i, wide_d
                    held = np.cumsum(np.where(ids >= 0, sizes[np.maximum(ids, 0)], 0), 1)
                read = (dist <= REACH * dist[:, :1]) | (np.arange(ids.shape[1]) < LEAST_LISTS) | (np.c_[np.zeros(len(v)), held[:, :-1]] < want)
                row, col = np.nonzero(read & (ids >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), part.column("id").take(pa.array(row)), part.column("v").take(pa.array(row))], ["list", "query_id", "q"])

    return route


def _best(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def best(queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not len(queries) or not len(entries):
            return schema.empty_table()
        ids = entries["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        v = _matrix(entries["v"].combine_chunks())[order]
        ids, starts = np.unique(ids[order], return_index=True)
        out: list[list] = [[], [], []]
        for q, i in zip(_matrix(queries["q"].combine_chunks()), queries["query_id"].to_pylist()):
            d = np.minimum.reduceat(np.sqrt(((v - q) ** 2).sum(1)), starts)  # an id is as near as its nearest vector
            d[ids == i] = np.inf
            near = np.argsort(d, kind="stable")[:k] if len(d) <= 4 * k else None
            if near is None:
                edge = np.partition(d, k)[k]
                near = np.flatnonzero(d <= edge)
                near = near[np.argsort(d[near], kind="stable")]
            near = near[np.isfinite(d[near])][:k]
            out[0] += [i] * len(near)
            out[1] += ids[near].tolist()
            out[2] += d[near].tolist()
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return best


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score`` (Euclidean distance): for each row of ``queries`` the ``k`` nearest found in ``vectors``.

    A query's own id is no candidate.  Ties go to the smaller id, from rank 1.
    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows with a null id.  A vector meets those of its own length:
    the most frequent length (the smaller of two) has the lists, other lengths
    are compared whole, in blocks.  Rows with the same id count once per id, at
    their nearest vector; of several vectors of one query id the least, by its
    components in order, asks.  Other columns are not read, empty tables give no rows.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`").cast("array<double>")
        df = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
        return df.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))

    all_ = clean(vectors)
    width = all_.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usual = F.size("v") == width["n"]
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    odd, odd_asked, all_, asked = all_.where(~usual).distinct(), asked.where(~usual), all_.where(usual).distinct(), asked.where(usual)
    picked = sampled(all_, sample, "id").collect()
    graph = CentroidGraph(bisect(np.array([r["v"] for r in picked]), PER_CENTROID))
    length_list = (-1 - F.size("v")).alias("list")  # a list for each other length
    lists = all_.mapInArrow(_post(graph), "list int, first boolean, id long, v array<double>")
    lists = checkpoint(lists.unionByName(odd.select(length_list, F.lit(True).alias("first"), "id", "v")))
    counts = lists.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("first"), F.col("id"))).alias("firsts"))
    sizes = np.zeros(len(graph.centroids), np.int64)
    held = {r["list"]: r for r in counts.collect()}  # a row per centroid, at most SAMPLE / PER_CENTROID * 2, and per other length
    for r in held.values():
        if r["list"] >= 0:
            sizes[r["list"]] = r["firsts"]
    asked = asked.mapInArrow(_route(graph, sizes, k + 1), "list int, query_id long, q array<double>")
    asked = checkpoint(asked.unionByName(odd_asked.select(length_list, F.col("id").alias("query_id"), F.col("v").alias("q"))))
    blocks = [(r["list"], -(-held[r["list"]]["n"] // BLOCK), -(-r["count"] // BLOCK)) for r in asked.groupBy("list").count().collect() if r["list"] in held]
    n_blocks = F.broadcast(vectors.sparkSession.createDataFrame(blocks, "list int, n_blocks int, n_asked int"))
    salt = lambda n, *of: F.pmod(F.xxhash64(*of), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    entries = lists.join(n_blocks, "list").select("list", salt("n_blocks", "id", "v").alias("block"), every("n_asked").alias("part"), "id", "v")
    asked = asked.join(n_blocks, "list").select("list", every("n_blocks").alias("block"), salt("n_asked", "query_id").alias("part"), "query_id", "q")
    found = asked.groupBy("list", "block", "part").cogroup(entries.groupBy("list", "block", "part")).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
