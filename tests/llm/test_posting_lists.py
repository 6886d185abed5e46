"""Repeated query ids, several lengths, other columns and the empty table."""

import math
import random

from pyspark.sql import functions as F

from pagewarrant.llm.op6_posting_lists import nearest

ROWS = "vec_id long, embedding array<double>, id string, v int, list int"


def _df(spark, rows, n=3):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], ROWS).repartition(n)


def _brute(rows, queries, k):
    out = []
    for i in sorted({q[0] for q in queries}):
        v = min(q[1] for q in queries if q[0] == i)
        best = {}
        for j, w in rows:
            if j != i and len(w) == len(v):
                best[j] = min(best.get(j, math.inf), math.dist(v, w))
        out += [(i, r + 1, j) for r, (d, j) in enumerate(sorted((round(d, 9), j) for j, d in best.items())[:k])]
    return out


def test_ids_and_lengths(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(0, 150, 10)]  # ids of two vectors
    rows += [(1000 + i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(20)] + [(2000, [1.0]), (2010, [3.0]), (2020, [1.0, 2.0, 3.0])]
    queries = [r for r in rows if r[0] % 10 == 0]
    want = _brute(rows, queries, 3)
    assert any(r[0] == 2000 for r in want) and not any(r[0] == 2020 for r in want)
    for n in (1, 5):
        got = nearest(_df(spark, rows, n), _df(spark, queries, n), 3).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == want
    assert nearest(_df(spark, []), _df(spark, queries)).count() == 0 and nearest(_df(spark, rows), _df(spark, [])).count() == 0
    assert nearest(_df(spark, rows), _df(spark, rows).where(F.col("vec_id") == 2020), 3).count() == 0
