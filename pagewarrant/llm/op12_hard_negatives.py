"""Hard negatives by Fagin's threshold algorithm.

Anchors and candidates meet in tiles of bounded size, every anchor with every
block of candidates.  A block has its rows sorted by each dimension.  An anchor
reads these lists from the end that its component's sign favours, all to the
same depth, and scores each row that it meets there in all dimensions
(integers, so scores are exact).  What it has not met scores at most the sum
of its components times the values last read; it stops once that threshold is
strictly below the last place of every window it fills, so that ties are met too.

Positives come first: tiles of one label, then the best of all tiles.  Their
scores give each anchor its windows, which it fills from tiles of all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpoint, few

#: Candidates and anchors of a tile, and the depth that lists are first read to.
BLOCK, ANCHORS, DEPTH = 4096, 4096, 64
#: Integers up to here are exact in the floating point of a matrix product.
_EXACT = 1 << 53


class SortedLists:
    """Rows with a list for each dimension, in ascending order of its values."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.argsort(rows, 0, kind="stable").T.copy()
        self.values = np.take_along_axis(rows, self.order.T, 0).T.copy()
        self.most = max(abs(int(rows.max())), abs(int(rows.min()))) if rows.size else 0
        self.floats = rows.astype(float)

    def scan(self, anchor: np.ndarray):
        """Rows met by sorted access, their scores, and the most that any other row can score (None: there is none), to ever greater depths."""
        n, exact = len(self.rows), sum(abs(int(x)) for x in anchor) * max(1, self.most) < _EXACT
        kind = float if exact else object
        rows, anchor = (self.floats if exact else self.rows.astype(object)), anchor.astype(kind)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, depth = np.zeros(n, bool), 0
        while True:
            to = min(n, max(DEPTH, 2 * depth)) if len(up) + len(down) else n
            now = met.copy()
            now[self.order[up, n - to : n - depth]] = True
            now[self.order[down, depth:to]] = True
            if to == n:
                now[:] = True
            new = np.flatnonzero(now & ~met)
            met, depth = now, to
            last = None if to == n else anchor[up] @ self.values[up, n - to].astype(kind) + anchor[down] @ self.values[down, to - 1].astype(kind)
            yield new, rows[new] @ anchor, last
            if last is None:
                return


def best(lists: SortedLists, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int | None, int | None]], k: int, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least and largest score, None: open) its first ``k`` allowed rows and their scores: higher first, ties by smaller id."""
    met, scores = [], []
    for new, score, last in lists.scan(anchor):
        kept = allowed[new]
        met.append(new[kept])
        scores.append(score[kept])
        if last is None:
            break
        so_far = np.concatenate(scores)
        for lo, hi in windows:
            own = so_far[(so_far >= lo if lo is not None else True) & (so_far <= hi if hi is not None else True)] if lo is not None or hi is not None else so_far
            end = np.sort(own)[-k] if len(own) >= k else lo
            if end is None or not last < end:
                break
        else:
            break
    met, scores = np.concatenate(met), np.concatenate(scores)
    out = []
    for lo, hi in windows:
        inside = np.flatnonzero((scores >= lo if lo is not None else np.ones(len(scores), bool)) & (scores <= hi if hi is not None else np.ones(len(scores), bool)))
        # of the rows below, first those that can be among the k, then in order
        if len(inside) > k:
            inside = inside[scores[inside] >= np.sort(scores[inside])[-k]]
        first = inside[np.lexsort((ids[met[inside]], -scores[inside]))][:k] if scores.dtype != object else np.array(sorted(inside, key=lambda i: (-scores[i], ids[met[i]]))[:k], int)
        out.append((met[first], scores[first]))
    return out


def _ints(table: pa.Table, n: int) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


_POSITIVES = pa.schema([("anchor", pa.int64()), ("mark", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_NEGATIVES = pa.schema([("anchor", pa.int64()), ("mark", pa.int64()), ("positive", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _positives(k: int):
    def tile(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(anchors) or not len(candidates):
            return _POSITIVES.empty_table()
        lists, ids, out = SortedLists(_ints(candidates, len(candidates))), candidates["id"].to_numpy(), []
        for i, mark, v in zip(anchors["id"].to_pylist(), anchors["mark"].to_pylist(), _ints(anchors, len(anchors))):
            ((rows, scores),) = best(lists, v, ids != i, [(None, None)], k, ids)
            out += [(i, mark, int(ids[r]), int(s)) for r, s in zip(rows, scores)]
        return _table(out, _POSITIVES)

    return tile


def _negatives(k: int, low: int, high: int):
    def tile(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(anchors) or not len(candidates):
            return _NEGATIVES.empty_table()
        lists, ids, out = SortedLists(_ints(candidates, len(candidates))), candidates["id"].to_numpy(), []
        names = {x: j for j, x in enumerate(dict.fromkeys(candidates["label"].to_pylist()))}
        labels = np.array([names[x] for x in candidates["label"].to_pylist()])
        columns = [anchors[n].to_pylist() for n in ("id", "mark", "label", "positives")]
        for i, mark, label, positives, v in zip(*columns, _ints(anchors, len(anchors))):
            # whole numbers s with low * p <= 100 * s <= high * p
            windows = {p: (-(-low * p // 100), high * p // 100) for p in positives}
            open_ = {p: w for p, w in windows.items() if w[0] <= w[1]}
            if not open_:
                continue
            found = dict(zip(open_, best(lists, v, (labels != names.get(label, -1)) & (ids != i), list(open_.values()), k, ids)))
            out += [(i, mark, at, int(ids[r]), int(s)) for at, p in enumerate(positives) if p in found for r, s in zip(*found[p])]
        return _table(out, _NEGATIVES)

    return tile


def _tiles(anchors: DataFrame, candidates: DataFrame, by: list[str], tile, schema: str) -> DataFrame:
    """Anchors meet candidates alike in ``by``, in blocks of both; a large label has more blocks."""
    parts = lambda df, n, size: df.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias(n))
    sizes = few(checkpoint(parts(candidates, "n_blocks", BLOCK).join(parts(anchors, "n_chunks", ANCHORS), by)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salt = lambda n: F.pmod(F.xxhash64("id", "mark"), F.col(n)).cast("int")
    fresh = lambda df: [F.col(c).alias(c) for c in df.columns]  # noqa: E731  anchors and candidates come from one table
    own = candidates.join(sizes, by).select(*fresh(candidates), salt("n_blocks").alias("block"), every("n_chunks").alias("chunk"))
    asked = anchors.join(sizes, by).select(*fresh(anchors), salt("n_chunks").alias("chunk"), every("n_blocks").alias("block"))
    keys = [*by, "block", "chunk"]
    return asked.groupBy(keys).cogroup(own.groupBy(keys)).applyInArrow(tile, schema)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group and their ``rank``: higher scores first, ties by smaller id."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows for which ``anchors`` holds.

    A component x becomes floor(scale * x), a score is an inner product of these.  An anchor's positives are its first rows of the
    same label, their negatives its first rows of another label that score
    ``low`` to ``high`` percent of the positive.  Higher scores come first, ties by smaller id; fewer rows, fewer results.

    Rows with a null id, label or vector or a null or non-finite component take
    no part.  Equal rows are one; an id with several vectors or labels is
    several rows, none a candidate of another of that id, and each is an anchor of its own.  Vectors meet
    those of their own length only; empty ones score 0.  Empty tables give no rows; other columns are not
    read.  Integers and scores beyond a long raise an error.
    """
    whole = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    numbers = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    long = F.transform(whole, lambda x: F.when(F.abs(x) * scale < 2.0**63, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is beyond a long"))))
    rows = vectors.withColumn("_k_asked", F.coalesce(anchors, F.lit(False))).where(numbers)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), long.alias("v"), F.col("_k_asked").alias("asked"))
    rows = rows.where("id is not null and label is not null").groupBy("id", "label", "v").agg(F.max("asked").alias("asked"))
    rows = checkpoint(rows.select("id", "label", "v", F.size("v").alias("length"), F.xxhash64("label", "v").alias("mark"), "asked"))
    asked, rows = rows.where("asked").drop("asked"), rows.drop("asked")
    positives = _first(_tiles(asked, rows, ["length", "label"], _positives(n_positives), "anchor long, mark long, id long, score long"), ["anchor", "mark"], n_positives)
    of = positives.groupBy("anchor", "mark").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("own"))
    of = checkpoint(of.select(F.col("anchor").alias("id"), "mark", "own"))
    windowed = asked.join(of, ["id", "mark"]).withColumn("positives", F.transform("own", lambda x: x["score"])).drop("own")
    found = _tiles(windowed, rows, ["length"], _negatives(n_negatives, low, high), "anchor long, mark long, positive int, id long, score long")
    found = _first(found, ["anchor", "mark", "positive"], n_negatives)
    named = of.select(F.col("id").alias("anchor"), "mark", F.posexplode("own").alias("positive", "p"))
    return found.join(named, ["anchor", "mark", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score")
    )
