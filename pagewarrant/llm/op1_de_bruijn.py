"""Substring deduplication over compacted De Bruijn graphs of word windows.

An edge of the graph is a window of ``size`` words; the nodes it joins are its
first and its last ``size - 1`` words.  Spark's exchanges (``repeats``) bring
the edges of all documents that share a name together, in the order of their
source texts.  There, an edge that has the same single edge after it and before
it wherever it occurs continues a path; other edges start one.  Compacted paths
are found again at each source coordinate by their head edge and length, their
words are compared in full, and the smallest id among equal paths decides which
occurrences go.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import hashing as H
from .repeats import HOT_RUNS, remove_repeats

SIZE = 13


def _alone(edges: np.ndarray, others: np.ndarray, n_edges: int) -> np.ndarray:
    """Edges that always have the same neighbour; -1 stands for none, which is a branch."""
    least, most = np.full(n_edges, np.iinfo(np.int64).max), np.full(n_edges, -2)
    np.minimum.at(least, edges, others)
    np.maximum.at(most, edges, others)
    return (least == most) & (least >= 0)


def path_classes(size: int):
    """Class numbers of word windows, for ``repeats.remove_repeats``: (compacted path, place in it)."""

    def classes(contents: list[bytes], names: np.ndarray) -> list[np.ndarray]:
        words = [c.split(b" ") for c in contents]
        buf = np.frombuffer(b"\n".join(contents) + b"\n", np.uint8)
        off = np.cumsum([0] + [len(c) + 1 for c in contents])
        _, _, hashes, units = H.words(buf, off, ~H.SPACE)
        count = np.diff(units) - size + 1
        run = np.repeat(np.arange(len(contents)), count)
        place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        found, edge = np.unique(H.gram_hashes(hashes, size)[units[run] + place], return_inverse=True)
        first, last = place == 0, np.r_[place[1:] == 0, True]
        after = np.where(last, -1, np.r_[edge[1:], -1])
        before = np.where(first, -1, np.r_[-1, edge[:-1]])
        one_after, one_before = _alone(edge, after, len(found)), _alone(edge, before, len(found))
        # a path starts where the edge before branches or this one can be reached otherwise
        starts = first | ~one_before[edge] | ~one_after[np.where(first, 0, before)]
        head = np.flatnonzero(starts)
        length = np.diff(np.r_[head, len(run)])
        # source coordinates give a path's words
        seen: dict[tuple, int] = {}
        number = np.empty(len(head), np.int64)
        total = 0
        for k, (r, p, n) in enumerate(zip(run[head].tolist(), place[head].tolist(), length.tolist())):
            key = tuple(words[r][p : p + n + size - 1])
            got = seen.get(key)
            if got is None:
                got = seen[key] = total
                total += n
            number[k] = got
        flat = np.repeat(number, length) + np.arange(len(run)) - np.repeat(head, length)
        return np.split(flat, np.cumsum(count)[:-1])

    return classes


def de_bruijn_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_text: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Cut every word that a ``size``-word window covers which also starts in a document with a smaller id.

    Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r.
    Returns one row per row of ``docs`` with ``_k_id``, ``_k_row`` (struct of its
    other columns), ``n_units`` (words), ``removed`` (spans [start, end) in
    words) and ``kept`` (remaining words joined by one space, UTF-8).  Windows
    are judged on the input.

    Null text has no words; shorter texts are kept; a null id is kept whole and
    compared with nothing; rows with the same id are one document; an empty
    table gives no rows.
    """
    spec = H.WordWindows(size, max(1, min(5, size - 1)))
    return remove_repeats(docs, spec, path_classes(size), id_col, text_col, with_text, hot_runs)
