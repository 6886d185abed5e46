"""Repeat removal against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewarrant.llm import op10_suffix_array as sorter
from pagewarrant.llm.op1_de_bruijn import de_bruijn_dedup
from pagewarrant.llm.op10_suffix_array import sort_alone, suffix_array, suffix_array_dedup, suffix_arrays


def brute(docs, size, units, join):
    """docs: (id, text); the contract, literally."""
    least = {}
    for i, t in docs:
        u = units(t)
        for k in range(len(u) - size + 1) if i is not None else ():
            w = tuple(u[k : k + size])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in docs:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - size + 1) if i is not None else ():
            if least[tuple(u[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(u), sum(gone), spans, hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    got = df.select(
        "_k_id", "n_units", F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.size("removed"), F.sha2("kept", 256)
    ).collect()
    return sorted((tuple(r) for r in got), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    line = " ".join(rng.choice(vocab) for _ in range(30))
    base = " ".join(rng.choice(vocab) for _ in range(200))
    docs = []
    for i in range(n):
        kind = rng.random()
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120)))
        if kind < 0.3:
            text = text[: rng.randint(0, 40)] + line + text[:20]
        elif kind < 0.5:
            words = base.split()
            words[rng.randrange(len(words))] = "zz"
            text = " ".join(words)
        elif kind < 0.6 and docs:
            text = rng.choice(docs)[1]
        elif kind < 0.65:
            text = "ab" * rng.randint(1, 300)
        elif kind < 0.7:
            text = "x \t\n" + (text or "") * 3
        docs.append((i * 7 % 131, text))
    docs += [(1000, None), (1001, ""), (None, base), (1002, base), (1002, base), (1003, "é" * 300), (1004, "é" * 299 + "q")]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for size, hot in ((50, 1024), (30, 1)):
        assert rows(suffix_array_dedup(df, size=size, hot_runs=hot)) == brute(docs, size, lambda t: list((t or "").encode()), bytes)


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for size, hot in ((13, 1024), (7, 1)):
        assert rows(de_bruijn_dedup(df, size=size, hot_runs=hot)) == brute(docs, size, lambda t: (t or "").encode().split(), b" ".join)


def test_many_contexts_of_one_line(spark):
    """More contents around one line than are sorted as one text, and a line in most documents."""
    rng = random.Random(3)
    line = "this line is in all of the documents and it is longer than fifty bytes"
    docs = [(i, "".join(rng.choice("abcdefgh ") for _ in range(80)) + line + "".join(rng.choice("abcdefgh ") for _ in range(80))) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 50, lambda t: list(t.encode()), bytes)
    for hot in (1024, 10_000):  # by single windows, and all contexts sorted as one text
        assert rows(suffix_array_dedup(df, hot_runs=hot)) == want


def test_one_id_and_no_id(spark):
    """A third of the rows under one id or none: no comparison within, all spread."""
    rng = random.Random(6)
    shared = " ".join(f"s{rng.randrange(99)}" for _ in range(40))
    docs = [(5, shared + f" {i}") for i in range(60)] + [(None, shared + f" {i}") for i in range(60)] + [(i, f"{i} " + shared) for i in range(3, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert rows(suffix_array_dedup(df)) == brute(docs, 50, lambda t: list(t.encode()), bytes)
    assert rows(de_bruijn_dedup(df)) == brute(docs, 13, lambda t: t.encode().split(), b" ".join)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array_dedup(empty).count() == 0 and de_bruijn_dedup(empty).count() == 0
    clash = spark.createDataFrame([(1, "a" * 60, "x", 1), (2, "a" * 60, None, 2)], "doc_id long, text string, segment string, kept int")
    got = {r["_k_id"]: r for r in suffix_array_dedup(clash).collect()}
    assert got[1]["_k_row"]["segment"] == "x" and got[2]["_k_row"]["kept"] == 2 and got[2]["kept"] == b""


def test_one_long_text_is_sorted_alone():
    rng = random.Random(9)
    for n, letters in ((400, 1), (400, 2), (700, 3), (5000, 2), (5000, 200)):
        t = [rng.randint(1, letters) for _ in range(n)]
        assert sort_alone(t) == sorted(range(n), key=lambda i: t[i:])
    t = b"abracadabra " * 400
    assert sort_alone([c + 1 for c in t]) == sorted(range(len(t)), key=lambda i: t[i:])
    assert sort_alone([]) == [] and sort_alone([7]) == [0]


def test_suffix_arrays():
    rng = random.Random(5)
    for _ in range(150):
        t = bytes(rng.randint(65, 65 + rng.choice([0, 1, 2, 20])) for _ in range(rng.randint(1, 40)))
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    grid = np.random.default_rng(1).integers(1, 4, (40, 60))
    for row, order in zip(grid, suffix_arrays(grid)):
        assert order.tolist() == sorted(range(60), key=lambda i: row[i:].tolist())


@pytest.mark.parametrize("n_groups, size, together", [(5, 50, False), (5, 6, False), (60, 50, True), (60, 6, True)])
def test_windows_of_few_and_of_many_names(monkeypatch, n_groups, size, together):
    rng = random.Random(n_groups + size)
    seen = []
    sort = sorter.suffix_arrays
    monkeypatch.setattr(sorter, "suffix_arrays", lambda grid: seen.append(len(grid)) or sort(grid))
    contents, names = [], []
    for g in range(n_groups):
        passage = bytes(rng.choice(b"ab") for _ in range(90))
        runs = {bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))) + passage[rng.randint(0, 9) : rng.randint(70, 90)] for _ in range(30)}
        contents += sorted(runs)
        names += [g] * len(runs)
    found = sorter.equal_windows(size)(contents, np.array(names, np.uint64))
    number = {}
    for name, content, numbers in zip(names, contents, found):
        assert len(numbers) == len(content) - size + 1
        for k, x in enumerate(numbers.tolist()):
            assert number.setdefault((name, content[k : k + size]), x) == x
    assert len(set(number.values())) == len(number)
    # a step of the common sorter costs about the same for one text as for many
    assert bool(seen) == together and all(rows > 1 for rows in seen)
