"""Hashed word features of texts and sparse logistic regression on bounded samples."""

from __future__ import annotations

import numpy as np

from . import hashing as H

#: Letters of words: a-z and non-ASCII bytes.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case, for ASCII and the Latin-1 letters."""
    out = H.LOWER[buf]
    if len(out) > 1:
        upper = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def word_features(buf: np.ndarray, offsets: np.ndarray, dims: int, prefixes: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each word and of its prefixes in bytes."""
    low = lower_latin(buf)
    starts, ends, hashes, units = H.words(low, offsets, LETTERS)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.searchsorted(units, np.arange(len(starts)), "right") - 1
    docs, feats = [owner], [(hashes % H.U(dims)).astype(np.int64)]
    for n in prefixes:
        grams = H.gram_hashes(low.astype(np.uint64) + H.U(1), n, 0x9E3779B97F4A7C15)
        long = ends - starts >= n
        docs.append(owner[long])
        feats.append((H.mix(grams[starts[long]] + H.U(n)) % H.U(dims)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(feats)


def counted(docs: np.ndarray, feats: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, feature) with log(1 + count)."""
    code, n = np.unique(docs * dims + feats, return_counts=True)
    return code // dims, code % dims, np.log1p(n)


def fit_sparse(rows, cols, values, n_rows: int, n_cols: int, labels, weights, pairs=(), l1: float = 2e-4, pull: float = 1.0, steps: int = 300):
    """Logistic regression by accelerated proximal gradient: L1 on weights, and a quadratic penalty ``pull`` on
    score differences of counterfactual ``pairs`` (rows, cols, values of the differences, their number)."""
    y, total = np.asarray(labels, float), float(np.sum(weights)) or 1.0
    weights = np.asarray(weights, float) / total
    share = float(np.clip(weights @ y, 1e-4, 1 - 1e-4))
    w, bias = np.zeros(n_cols), float(np.log(share / (1 - share)))  # the prior, for texts without features
    p_rows, p_cols, p_values, n_pairs = pairs if len(pairs) else (np.empty(0, int), np.empty(0, int), np.empty(0), 0)

    def curvature(x):
        """The largest curvature of the loss along x (weights, then bias), and its direction."""
        score = np.bincount(rows, values * x[cols], n_rows) + x[-1]
        out = np.r_[np.bincount(cols, values * (weights * score)[rows], n_cols), weights @ score] / 4
        if n_pairs:
            gap = np.bincount(p_rows, p_values * x[p_cols], n_pairs)
            out[:-1] += 2 * pull / n_pairs * np.bincount(p_cols, p_values * gap[p_rows], n_cols)
        return out

    x = np.ones(n_cols + 1)
    for _ in range(20):
        x = curvature(x / np.linalg.norm(x))
    step_size = 0.9 / max(float(np.linalg.norm(x)), 1e-6)
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(steps):
        score = np.bincount(rows, values * v[cols], n_rows) + vb
        error = weights * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y)
        grad = np.bincount(cols, values * error[rows], n_cols)
        if n_pairs:
            gap = np.bincount(p_rows, p_values * v[p_cols], n_pairs)
            grad += 2 * pull / n_pairs * np.bincount(p_cols, p_values * gap[p_rows], n_cols)
        new = v - step_size * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step_size * l1, 0)
        new_bias = vb - step_size * float(error.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, bias
