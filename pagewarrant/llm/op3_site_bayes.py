"""Quality by hierarchical empirical Bayes over sites.

A document classifier (logistic regression on measures of the text) gives each
document evidence.  Grouped aggregations over all documents give each host and
each path of a host the mean of that evidence; a path's posterior shrinks to its
host's, a host's to the global one, with prior strengths estimated from the
spread between groups (method of moments).  A document's score combines its own
evidence with how the posterior that its path would have without it differs from
the global prior, so that no evidence counts twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .features import fit_sparse
from .op4_toxicity import held_out
from .session import bounded_batches, checkpoint, few, one_text, sampled

#: Labelled rows that the fit sees at most, those with the least hash of their id.
SAMPLE = 8000
MEASURES = 12
_CLASSES = np.zeros((256, 6), np.float32)
_CLASSES[0x41:0x5B, 0] = 1  # upper case
_CLASSES[0x30:0x3A, 1] = 1  # digits
_CLASSES[[ord(c) for c in "#$%&*@^~<>|=+_\\{}[]"], 2] = 1  # symbols
_CLASSES[[ord(c) for c in "!?"], 3] = 1
_CLASSES[[ord(c) for c in ".,;:'\"()-"], 4] = 1
_CLASSES[0x0A, 5] = 1


def measures(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of measures per text: shares of kinds of bytes, lengths, repetition."""
    n = np.maximum(np.diff(off), 1)
    out = np.zeros((len(off) - 1, MEASURES))
    for k in range(6):
        total = np.r_[0, np.cumsum(_CLASSES[buf, k])]
        out[:, k] = (total[off[1:]] - total[off[:-1]]) / n
    starts, ends, hashes, units = H.words(buf, off, ~H.SPACE)
    words = np.diff(units)
    out[:, 6] = np.log1p(words) / 8
    out[:, 7] = np.minimum(2, n / np.maximum(words, 1) / 8)
    owner = np.searchsorted(units, np.arange(len(hashes)), "right") - 1
    grams = H.gram_hashes(hashes, 3)
    inside = np.arange(len(grams)) + 3 <= units[owner[: len(grams)] + 1] if len(grams) else np.zeros(0, bool)
    for k, (h, o) in ((8, (hashes, owner)), (9, (grams[inside], owner[: len(grams)][inside]))):
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
        distinct, every = np.bincount(o[new], minlength=len(n)), np.bincount(o, minlength=len(n))
        out[:, k] = distinct / np.maximum(every, 1)
    out[:, 10], out[:, 11] = (words < 20), (words < 60)
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x**2, np.sqrt(np.abs(x))], 1)


class Model:
    def __init__(self, mean, scale, weights, bias):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((_expand(x) - self.mean) / self.scale, -8, 8) @ self.weights + self.bias, -12, 12)


def _measured(batches):
    for batch in batches:
        buf, off = H.column_bytes(batch.column("_k_text"))
        rows = [measures(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in H.chunks(off)]
        x = np.concatenate(rows) if rows else np.zeros((0, MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(np.arange(0, x.size + 1, MEASURES, dtype=np.int32), pa.array(x.ravel()))], ["label", "x"])


def fit(own: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from texts and labels; the sample is chosen among ids, which are broadcast to the texts; a repeated id counts once."""
    ids = sampled(checkpoint(own.select("_k_id").where(~held_out("_k_id")).distinct().join(marks, "_k_id")), sample)
    rows = one_text(own, ids).mapInArrow(_measured, "label int, x array<double>").collect()
    y = np.array([r["label"] for r in rows])
    if not len(y) or len(set(y.tolist())) < 2:
        return Model(0.0, 1.0, np.zeros(3 * MEASURES), 0.0 if not len(y) else (6.0 if y[0] else -6.0))
    x = _expand(np.array([r["x"] for r in rows]))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    i, j = np.divmod(np.arange(z.size), z.shape[1])
    w, b = fit_sparse(i, j, z.ravel(), len(z), z.shape[1], y, np.ones(len(y)), l1=1e-4, steps=400)
    return Model(mean, scale, w, float(b))


def _evidence(model: Model):
    def evidence(batches):
        for batch in batches:
            buf, off = H.column_bytes(batch.column("_k_text"))
            got = [model.log_odds(measures(buf[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in H.chunks(off)]
            names = [n for n in batch.schema.names if n != "_k_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(got) if got else np.empty(0))], [*names, "evidence"])

    return evidence


def _logit(p: F.Column) -> F.Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> float:
    """Prior strength (pseudo-documents) from the spread of group means: within variance over between variance."""
    total = F.sum("n")
    row = groups.agg(total.alias("n"), (F.sum(F.col("n") * F.col("mean")) / total).alias("m"), F.count("*").alias("k"), F.sum(F.col("squares") - F.col("n") * F.col("mean") ** 2).alias("inside"), F.sum(F.col("n") * F.col("mean") ** 2).alias("ms"), F.sum(F.col("n").cast("double") ** 2).alias("nn")).first()
    if not row["n"] or row["k"] < 2 or row["n"] <= row["k"]:
        return 10.0
    within = row["inside"] / (row["n"] - row["k"])
    size = (row["n"] - row["nn"] / row["n"]) / (row["k"] - 1)
    between = max(((row["ms"] - row["n"] * row["m"] ** 2) / (row["k"] - 1) - within) / max(size, 1e-9), 1e-6)
    return float(min(max(within / between, 1.0), 1000.0))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: F.Column | None = None, path: F.Column | None = None, label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``_k_id, held_out, evidence, host_posterior, path_posterior, score, predicted`` for every row of ``docs``.

    ``host`` and ``path`` are columns of ``docs`` (default ``source`` and
    ``lang``); null ones are a group of their own.  Labels are 0 or 1 by id
    (the highest of several); held-out rows are never learnt from.  ``score`` is
    the probability of quality 1.

    Null and empty texts are scored by their measures, all zero; very long ones
    by their whole length.  Repeated rows count each in their groups and are
    scored alike (they are learnt from once); a score of exactly 0.5 is
    predicted 1.  Without labels of both kinds the evidence is that of the one
    that there is, or 0.  An empty table gives no rows.  Columns other than id,
    text, host and path are not read.
    """
    bounded_batches(docs.sparkSession)
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    own = docs.select(
        F.col(f"`{id_col}`").alias("_k_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.concat_ws("/", F.coalesce(host.cast("string"), F.lit("")), F.coalesce(path.cast("string"), F.lit(""))).alias("path"), F.col(f"`{text_col}`").alias("_k_text")
    )
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_k_id")).agg(F.max(label_col).cast("int").alias("label")).where("_k_id is not null")
    model = fit(own, marks, sample)
    scored = own.mapInArrow(_evidence(model), own.drop("_k_text").schema.add("evidence", "double"))
    scored = checkpoint(scored.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))))  # texts are measured once
    paths = checkpoint(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.sum(F.col("p") ** 2).alias("squares")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean_host"), F.sum("squares").alias("squares"))
    whole = hosts.agg((F.sum(F.col("n_host") * F.col("mean_host")) / F.sum("n_host")).alias("m")).first()["m"]
    prior = 0.5 if whole is None else float(whole)
    a_host = _strength(hosts.select(F.col("n_host").alias("n"), F.col("mean_host").alias("mean"), "squares"))
    a_path = _strength(paths)
    posterior = few(checkpoint(paths.join(hosts.drop("squares"), "host").select("path", "n", "mean", "n_host", "mean_host")))

    def shrunk(n, mean, n_host, mean_host):
        """Posteriors of a host and of a path of it."""
        of_host = (n_host * mean_host + a_host * prior) / (n_host + a_host)
        return of_host, (n * mean + a_path * of_host) / (n + a_path)

    n, mean, n_host, mean_host, p = (F.col(c) for c in ("n", "mean", "n_host", "mean_host", "p"))
    of_host, of_path = shrunk(n, mean, n_host, mean_host)
    others = F.greatest(n - 1, F.lit(1)), F.greatest(n_host - 1, F.lit(1))
    _, without = shrunk(n - 1, (n * mean - p) / others[0], n_host - 1, (n_host * mean_host - p) / others[1])
    out = scored.join(posterior, "path").withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(without) - _logit(F.lit(prior))))))
    out = out.withColumn("host_posterior", of_host).withColumn("path_posterior", of_path)
    return out.select("_k_id", held_out("_k_id").alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
