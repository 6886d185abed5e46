"""Hard negatives against all inner products in plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pagewarrant.llm import op12_hard_negatives as H

ROWS = "vec_id long, embedding array<double>, label int, id string, v string"


def _brute(rows, asked):
    kept = {(i, x, tuple(math.floor(256 * c) for c in v)) for i, v, x in rows if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for i, x, v in kept:
        if not asked(i):
            continue
        other = [(sum(a * b for a, b in zip(v, w)), j, y) for j, y, w in kept if j != i and len(w) == len(v)]
        other.sort(key=lambda r: (-r[0], r[1]))
        for p, j, _ in [r for r in other if r[2] == x][:5]:
            negatives = [r for r in other if r[2] != x and 50 * p <= 100 * r[0] <= 95 * p][:3]
            out += [(i, j, k + 1, n[1], p, n[0]) for k, n in enumerate(negatives)]
    return sorted(out)


def _got(spark, rows, n=3):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS).repartition(n)
    out = H.hard_negatives(df, F.col("vec_id") % 5 == 0)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out.collect())


def _rows(n, width, seed, spread=0.2, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


def test_against_plain_python(spark, monkeypatch):
    rows = _rows(400, 8, 1) + _rows(60, 3, 2)[:0]
    rows += [(1000 + i, [round(2 * x) / 2 for x in v], x2) for i, (_, v, x2) in enumerate(_rows(120, 4, 3, 0.6))]  # many ties
    rows += [(2000, None, 1), (2005, [0.1] * 8, None), (None, [0.1] * 8, 1), (2010, [0.1, None] * 4, 1), (2015, [float("nan")] * 8, 1), (2020, [float("inf")] * 8, 1), (2025, [0.0] * 8, 2), (2030, [], 1), (2031, [], 1), (2032, [], 2)]
    rows += [rows[10], rows[10], (10, rows[11][1], rows[11][2]), (2040, [1.0] * 8, 0)] + [(2100 + i, [0.5] * 8, i % 3) for i in range(40)]
    want = _brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 500 and any(r[0] == 2030 for r in want)
    assert _got(spark, rows) == want
    monkeypatch.setattr(H, "BLOCK", 50)
    monkeypatch.setattr(H, "ANCHORS", 20)
    assert _got(spark, rows, 7) == want


def test_few_and_no_rows(spark):
    assert _got(spark, []) == [] and _got(spark, [(5, [1.0], 1)]) == [] and _got(spark, [(5, [1.0], 1), (6, [1.0], 1)]) == []
    rows = [(5, [1.0], 1), (6, [1.0], 1), (7, [0.6], 2), (8, [-1.0], 2)]
    assert _got(spark, rows) == _brute(rows, lambda i: i % 5 == 0) == [(5, 6, 1, 7, 65536, 39168)]


def test_search_stops_early_and_finds_all():
    rng = np.random.default_rng(5)
    rows = rng.integers(-40, 40, (3000, 4))
    rows[::50] += 400
    lists, anchor = H.SortedLists(rows), np.array([3, -2, 0, 5])
    read = sum(len(new) for new, _, last in H.SortedLists(rows).scan(anchor))
    assert read == 3000
    ids, allowed = np.arange(3000)[::-1].copy(), rng.random(3000) < 0.7
    scores = rows @ anchor
    met = []
    scan = lists.scan
    lists.scan = lambda a: (met.append(len(x[0])) or x for x in scan(a))
    ((got, s),) = H.best(lists, anchor, allowed, [(None, None)], 5, ids)
    want = sorted((k for k in range(3000) if allowed[k]), key=lambda k: (-scores[k], ids[k]))[:5]
    assert got.tolist() == want and s.tolist() == scores[want].tolist() and sum(met) < 1500
    for lo, hi in ((100, 900), (900, 100), (-(10**6), -300), (10**5, 10**6)):
        ((got, _),) = H.best(H.SortedLists(rows), anchor, allowed, [(lo, hi)], 5, ids)
        assert got.tolist() == sorted((k for k in range(3000) if allowed[k] and lo <= scores[k] <= hi), key=lambda k: (-scores[k], ids[k]))[:5]


def test_scores_beyond_floating_point_are_exact():
    rows = np.array([[1 << 30, 3], [(1 << 30) + 1, 2], [1 << 30, 2]], np.int64)
    ((got, s),) = H.best(H.SortedLists(rows), np.array([1 << 30, 1]), np.ones(3, bool), [(None, None)], 2, np.array([7, 8, 9]))
    assert got.tolist() == [1, 0] and [int(x) for x in s] == [(1 << 60) + (1 << 30) + 2, (1 << 60) + 3]
