"""The pipeline's stages take effect, and the subpackage's queries are registered."""

import random

import corpus_pipeline
from pagewarrant.llm import queries


def _docs(spark):
    rng = random.Random(7)
    vocab = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, passage = text(30), text(40)
    docs, labels = [], []
    for i in range(120):
        t = text(60)
        if i % 4 == 0:
            w = t.split()
            w[5], w[20], w[40] = "idiot", "moron", "scum"
            t = " ".join(w)
        docs.append((i, t))
        labels.append((i, int(i % 4 == 0)))
    docs += [(200, docs[1][1]), (201, docs[2][1] + " tail"), (202, text(20) + " " + item), (203, text(50) + " " + passage), (204, text(50) + " " + passage), (205, None), (206, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    return df, spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("doc_id", "1 as quality", "quality as toxic"), spark.createDataFrame([(1, item)], "item_id long, text string"), dict(docs), passage


def test_stages(spark, tmp_path):
    docs, labels, items, texts, passage = _docs(spark)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert now.columns == docs.columns
            kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert not any(i % 4 == 0 and i < 120 for i in kept["toxicity"]) and {1, 3, 205, 206} <= set(kept["toxicity"])
    assert {200, 201}.isdisjoint(kept["ngram_jaccard_join"]) and {1, 2, 202, 203, 204} <= set(kept["ngram_jaccard_join"])
    cut = kept["suffix_array_dedup"]
    assert cut[203] == texts[203] and passage not in cut[204] and len(cut[204]) < len(texts[204]) - len(passage) + 2
    assert 202 not in kept["benchmark_decontamination"] and {1, 203, 204} <= set(kept["benchmark_decontamination"])
    assert {r["doc_id"] for r in now.collect()} == set(kept["benchmark_decontamination"])
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "ids_crc32").collect()) == sorted(now.select("doc_id", "start", "ids_crc32").collect())


def test_near_copies_row_by_row(spark, tmp_path):
    """Repeated ids with differing texts, null ids, rows without words, an empty table."""
    rng = random.Random(2)
    a, b, c = (" ".join(f"w{rng.randrange(10_000)}" for _ in range(30)) for _ in range(3))
    docs = [(1, a, "x"), (1, b, "y"), (1, None, "z"), (2, b + " t", "x"), (3, c, "x"), (3, c, "x"), (3, c.replace(" ", "  "), "x"), (4, "", "x"), (None, a, "x"), (5, a, "x"), (5, "another text", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _k_key string")
    got = sorted((tuple(r) for r in corpus_pipeline.drop_near_copies(spark, df.withColumnRenamed("_k_key", "source"), "").collect()), key=str)
    want = [(1, a, "x"), (1, b, "y"), (1, None, "z"), (3, min(c, c.replace(" ", "  ")), "x"), (4, "", "x"), (None, a, "x"), (5, "another text", "x")]
    assert got == sorted(want, key=str)
    assert corpus_pipeline.drop_near_copies(spark, df.where("false"), "").count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_odd_rows_pass_through_the_stages(spark, tmp_path):
    """Null ids, repeated ids, a map column and columns named like internal ones in all five stages."""
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = text(30)
    rows = [(i, text(60)) for i in range(60)]
    bad = " ".join(["idiot", "moron", "scum", *text(40).split()])
    rows += [(i, f"{bad} {text(5)}") for i in range(60, 90)]
    rows += [(None, text(50)), (None, rows[3][1]), (None, text(10) + " " + item), (None, None), (None, ""), (5, text(40)), (5, rows[5][1]), (6, None), (200, "Z " * 20_000)]
    schema = "doc_id long, text string, _k_key string, _k_row string, n_chars int, tags map<string,int>"
    docs = spark.createDataFrame([(i, t, f"own{k}", "r", len(t or ""), {"a": k}) for k, (i, t) in enumerate(rows)], schema)
    labels = spark.createDataFrame([(i, 1, int(60 <= i < 90)) for i in range(90)], "doc_id long, quality int, toxic int")
    for name, df in (("labels", labels), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append(now.collect())
        if k < 4:
            assert now.columns == docs.columns and all(r["_k_key"] == f"own{r['tags']['a']}" and r["_k_row"] == "r" for r in kept[k])
    own = [{r["tags"]["a"] for r in x} for x in kept[:4]]
    assert {*range(60), *range(90, 99)} <= own[0] and not own[0] & set(range(60, 90))
    # the second of two rows alike in id and text is told by its other columns; null ids stay
    assert own[0] - own[1] in ({5}, {96}) and own[2] == own[1] and own[2] - own[3] == {92}
    none = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
