"""Toxicity by a counterfactually regularised classifier.

A sparse logistic regression over hashed words and word prefixes.  For labelled
texts that name a group of people, every group term is also swapped for other
terms and for none; the fit penalises the squared change of the score, so that the mention of
a group says nothing by itself.  Term weights are thereby pulled together and to
zero.

Document frequencies of features by label come from an aggregation over the
labelled rows of a bounded sample; the features that tell most go to the fit on
the driver.  Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .features import counted, fit_sparse, word_features
from .session import bounded_batches, checkpoint, one_text, releasing_batches, sampled

DIMS = 1 << 18
#: Weight of squared score changes against the mean log loss.
PULL = 10.0
#: Labelled rows of each class that the fit sees at most, those with the least hash of their id.
SAMPLE = 3000
#: Features of the fit.
FEATURES = 4096
#: A term is swapped for those so many places further in the list; 0: for none.
SWAPS = (0, 1, 5, 11)
#: Terms for groups of people that are swapped for each other.
IDENTITY_TERMS = (
    "asian atheist black blind buddhist catholic christian deaf disabled female gay hindu immigrant jewish latino lesbian male "
    "men muslim old protestant queer refugee sikh straight transgender white women young"
).split()


def _term_features() -> np.ndarray:
    """Features of each identity term: a row of its word and prefixes, -1 where it is too short."""
    buf = np.frombuffer("\n".join(IDENTITY_TERMS).encode(), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in IDENTITY_TERMS])
    docs, feats = word_features(buf, np.r_[0, ends[:-1], len(buf)], DIMS)
    out = np.full((len(IDENTITY_TERMS), 4), -1, np.int64)
    at = np.zeros(len(IDENTITY_TERMS), int)
    for d, f in zip(docs.tolist(), feats.tolist()):
        out[d, at[d]] = f
        at[d] += 1
    return out


def _vectors(kept: np.ndarray | None):
    """Rows (id, label, features, values) of sampled texts; with ``kept`` only its features, by place."""
    schema = pa.schema([("label", pa.int32()), ("features", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])

    def vectors(batches):
        for batch in batches:
            buf, off = H.column_bytes(batch.column("_k_text"))
            labels = batch.column("label").to_pylist()
            for a, b in H.chunks(off):
                docs, feats, values = counted(*word_features(buf[off[a] : off[b]], off[a : b + 1] - off[a], DIMS), DIMS)
                if kept is not None:
                    own = H.member(feats, kept)
                    docs, feats, values = docs[own], np.searchsorted(kept, feats[own]), values[own]
                at = np.searchsorted(docs, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels[a:b], pa.int32()), pa.ListArray.from_arrays(at, pa.array(feats)), pa.ListArray.from_arrays(at, pa.array(values))], schema=schema
                )

    return vectors


_VECTOR = "label int, features array<long>, values array<double>"


class Model:
    """Kept features in order, their weights, a bias."""

    def __init__(self, features, weights, bias: float):
        self.features, self.weights, self.bias = np.asarray(features, np.int64), np.asarray(weights, float), bias

    def score(self, buf, off) -> np.ndarray:
        docs, feats = word_features(buf, off, DIMS)
        own = H.member(feats, self.features)
        docs, feats, values = counted(docs[own], feats[own], DIMS)
        total = np.bincount(docs, values * self.weights[np.searchsorted(self.features, feats)], len(off) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(own: DataFrame, marks: DataFrame, sample: int = SAMPLE, pull: float = PULL) -> Model:
    """A model from texts (``_k_id, _k_text``) and labels (``_k_id, label``); without both labels it says 0 for all.

    The sample is chosen among ids; texts are joined to the chosen ids, which
    are broadcast, so no text is shuffled that the fit does not see.  A repeated
    id counts once, with the least of its texts.
    """
    ids = checkpoint(own.select("_k_id").where(~held_out("_k_id")).distinct().join(marks, "_k_id"))
    sizes = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model([], [], 0.0 if sizes.get(1) and not sizes.get(0) else -30.0)
    classes = [sampled(ids.where(F.col("label") == k), sample, n_rows=sizes[k]) for k in (0, 1)]
    rows = checkpoint(one_text(own, classes[0].unionByName(classes[1])))
    each = rows.mapInArrow(_vectors(None), _VECTOR).select("label", F.explode("features").alias("feature"))
    n0, n1 = (min(sample, sizes[k]) for k in (0, 1))
    seen = each.groupBy("feature").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    gap = F.col("n1") / n1 - F.col("n0") / n0
    share = (F.col("n1") + F.col("n0") + 1) / (n0 + n1 + 2)
    told = seen.orderBy(F.desc(F.abs(gap) / F.sqrt(share * (1 - share) + 1e-6)), "feature").limit(FEATURES)
    terms = _term_features()
    kept = np.unique(np.r_[[r["feature"] for r in told.select("feature").collect()], terms[terms >= 0]].astype(np.int64))
    got = rows.mapInArrow(_vectors(kept), _VECTOR).collect()  # at most twice ``sample`` rows of FEATURES
    labels = np.array([r["label"] for r in got])
    counts = [len(r["features"]) for r in got]
    rows_ = np.repeat(np.arange(len(got)), counts)
    cols = np.concatenate([np.array(r["features"], np.int64) for r in got] + [np.empty(0, np.int64)])
    values = np.concatenate([np.array(r["values"]) for r in got] + [np.empty(0)])
    pairs = _counterfactuals(rows_, cols, values, kept, terms)
    weights = np.where(labels == 1, sizes[1] / max(1, int((labels == 1).sum())), sizes[0] / max(1, int((labels == 0).sum())))
    w, bias = fit_sparse(rows_, cols, values, len(got), len(kept), labels, weights, pairs, pull=pull)
    return Model(kept[w != 0], w[w != 0], float(bias))


def _counterfactuals(rows, cols, values, kept, terms):
    """Vectors of texts less those of the same texts with a term swapped for later terms of the list, or for none.

    Every occurrence of the term is swapped, and the words and prefixes of the
    new text are counted anew: prefixes that both terms have stay, and a term
    that the text has already is counted with those that it had.
    """
    at = np.where(terms >= 0, np.searchsorted(kept, np.maximum(terms, 0)), -1)
    by_word = {int(a[0]): k for k, a in enumerate(at)}
    own = np.flatnonzero(np.isin(cols, at[at >= 0]))
    count = {(r, c): int(round(n)) for r, c, n in zip(rows[own].tolist(), cols[own].tolist(), np.expm1(values[own]).tolist())}
    p_rows, p_cols, p_values, n = [], [], [], 0
    for (row, col), times in count.items():
        if col not in by_word:
            continue
        # another word may share the term's hash, but hardly those of all its prefixes too
        term = at[by_word[col]][at[by_word[col]] >= 0].tolist()
        times = min(count.get((row, c), 0) for c in term)
        if not times:
            continue
        for step in SWAPS:
            change = dict.fromkeys(term, -times)
            if step:
                other = at[(by_word[col] + step) % len(terms)]
                for c in other[other >= 0].tolist():
                    change[c] = change.get(c, 0) + times
            for c, more in change.items():
                before = count.get((row, c), 0)
                p_rows.append(n)
                p_cols.append(c)
                p_values.append(np.log1p(before) - np.log1p(before + more))
            n += 1
    return (np.array(p_rows), np.array(p_cols), np.array(p_values), n) if n else ()


def _score(model: Model):
    def score(batches):
        for batch in batches:
            buf, off = H.column_bytes(batch.column("_k_text"))
            scores = [model.score(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in H.chunks(off)]
            names = [n for n in batch.schema.names if n != "_k_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(scores) if scores else np.empty(0))], [*names, "score"])

    return score


def held_out(id_col: str = "doc_id", of: int = 5, rest: int = 0) -> F.Column:
    """Rows whose labels the fit must not see: crc32 of the id as text, modulo ``of``."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(of)) == rest, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, pull: float = PULL, with_text: bool = False) -> DataFrame:
    """Score every text: ``_k_id, _k_row`` (struct of the other columns), ``held_out, score`` (0 to 1), ``predicted``.

    Labels are 0 or 1 by id; other values and null ids are ignored, and of
    several for one id the highest counts.  Rows held out (``held_out``) and
    unlabelled rows are only scored.  Null and empty texts get the bias alone;
    very long ones are read whole.  Repeated rows are scored each and learnt
    from once; a score of exactly 0.5 is predicted 1.  Without labels of both
    kinds, all get the one that there is, or 0.  An empty table gives no rows;
    other columns of any name come back in ``_k_row``.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    own = docs.select(F.col(f"`{id_col}`").alias("_k_id"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_k_row"), F.col(f"`{text_col}`").alias("_k_text"))
    if with_text:
        own = own.withColumn("_k_kept_text", F.col("_k_text"))
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_k_id")).agg(F.max(label_col).cast("int").alias("label")).where("_k_id is not null")
    model = fit(own, marks, sample, pull)
    schema = own.drop("_k_text").schema.add("score", "double")
    scored = own.mapInArrow(releasing_batches(_score(model)), schema)
    return scored.withColumn("held_out", held_out("_k_id")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
