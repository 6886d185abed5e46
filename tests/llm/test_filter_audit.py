"""The filter audit and its document-term matrix against plain Python."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewarrant.llm import term_matrix as M
from pagewarrant.llm.op13_filter_audit import filter_audit

DOCS = "doc_id long, text string, lang string, n_words int, A string, part string"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails, parts = [], []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        bad["E"] = i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in docs)
        fails.append({k for k, v in bad.items() if v})
        parts.append(lang or "")
    out, shap = {}, collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for step, c in enumerate(order):
            before = set(order[:step])
            for part in set(parts):
                own = [(d[0], f) for d, f, p in zip(docs, fails, parts) if p == part]
                here = [i for i, f in own if c in f and not f & before]
                out[part, "".join(order), step + 1] = [
                    sum(c not in f and not f & before for _, f in own), len(here), sum(c in f and bool(f & before) for _, f in own), sum(f == {c} for _, f in own), sum(i in good for i in here), sum(i in toxic for i in here),
                ]
                shap[part, c] += len(here)
    return {k: (*v, shap[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _docs():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)] + ["Ünï", "a b", "x y", "\x1c"]
    text = lambda n, k: rng.choice([" ", "\t", "\n\x0b", "\r\f "]).join(rng.choice(words[:k]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 20, 199, 200, 260]), rng.choice([40, 904])) + rng.choice(["", "", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3]), rng.choice(["en", "de", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[i][1], "fr") for i in range(0, 60, 5)] + [(None, docs[1][1], "en"), (None, None, None), (7, None, "en"), (8, "", "en"), docs[3], docs[3], (3, docs[4][1], "en"), (300, "Z " * 90_000, "en")]
    return docs


def _df(spark, docs):
    return spark.createDataFrame([(*d, 1, "clash", "clash") for d in docs], DOCS)


def test_against_plain_python(spark):
    docs = _docs()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 110, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (6, None, None), (9999, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("clash"))
    want = _brute(docs, labels)
    for n in (1, 7):
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in filter_audit(_df(spark, docs).repartition(n), known).collect()}
        assert got == want
    assert filter_audit(_df(spark, []), known).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["good_lost"] for r in filter_audit(_df(spark, docs), none).collect()} == {0}


def test_matrix(spark):
    docs = _docs()
    shards = M.local_shards(_df(spark, docs).repartition(3), "text", shard_bytes=2000)
    words = M.numbered_words(shards)
    number = {bytes(r["word"]): r["id"] for r in M.dictionary(words).collect()}
    assert sorted(number.values()) == list(range(len(number))) and set(number) == {w for _, t, _ in docs for w in (t or "").encode().split()}
    name = {i: w for w, i in number.items()}
    seen = []
    of = collections.defaultdict(list)
    for r in words.collect():
        of[r["shard"]].append((r["local"], r["id"]))
    for r in shards.toArrow().to_batches():
        for k in range(len(r)):
            one = pa.Table.from_batches([r.slice(k, 1)])
            local, ids = zip(*of[one["shard"][0].as_py()]) if of[one["shard"][0].as_py()] else ((), ())
            indptr, columns, counts = M.matrix(one, pa.table({"local": pa.array(local, pa.int32()), "id": pa.array(ids, pa.int64())}))
            for j, row in enumerate(one["rows"][0].as_py()):
                own = columns[indptr[j] : indptr[j + 1]]
                assert (np.diff(own) > 0).all()
                seen.append((row["doc_id"], row["lang"], tuple(sorted((name[c], int(n)) for c, n in zip(own, counts[indptr[j] : indptr[j + 1]])))))
    assert sorted(seen, key=repr) == sorted(((i, lang, tuple(sorted(collections.Counter((t or "").encode().split()).items()))) for i, t, lang in docs), key=repr)
    assert shards.count() > 20
