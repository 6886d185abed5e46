import json

from pyspark.sql import functions as F

from pagewarrant.operators import evidence as E
from pagewarrant.sources import texts as S


def card(**over):
    base = dict(id="c1", tag="t1", vendor="v", evidence_type="e", source_url="u", source_date="2026-01-01", source_checked_at="2026-01-02", expires_at="2026-02-01", summary="s", numbers={"n": "3"}, claim_limit="l")
    base.update(over)
    return {k: v for k, v in base.items() if v != "-"}


def lines(spark, texts):
    return spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)], "file string, line int, text string")


def test_registry(spark):
    rows = [json.dumps(card()), "", "{bad", "[1]", json.dumps(card(vendor="-")), json.dumps(card(summary=" ", numbers=3)), json.dumps(card(id="c2", source_date="2026-02-30")), json.dumps(card(id="c3", tag="t2", expires_at="2026-03-01", numbers={"a": ["is $ 5 now"]}))]
    good, bad = S.parse_json_lines(lines(spark, rows))
    assert [(r["line"], r["rule_id"]) for r in bad.orderBy("line").collect()] == [(3, "invalid_json"), (4, "not_an_object")]
    cards = E.cards_of(good)
    assert sorted((r["line"], r["rule_id"], r["detail"]) for r in E.check_required(cards).collect()) == [(5, "missing_fields", "vendor"), (6, "empty_fields", "summary"), (6, "numbers", "numbers must be a JSON object")]
    whole = E.complete(cards)
    assert [(r["line"], r["detail"]) for r in E.check_duplicates(whole).collect()] == [(6, "c1")]
    sound, errors = E.parse_dates(whole)
    assert [(r["line"], r["rule_id"], r["detail"]) for r in errors.collect()] == [(7, "not_a_date", "source_date")]
    assert sorted((r["line"], r["rule_id"]) for r in E.check_dates(sound, "2026-01-01", 30).collect()) == [(1, "future_check"), (6, "future_check"), (8, "expiry"), (8, "future_check")]
    assert {r["line"] for r in E.stale(sound, "2026-02-15").collect()} == {1, 6}
    assert {r["line"]: r["p"] for r in sound.select("line", E.has_exact_price(F.col("numbers")).alias("p")).collect()} == {1: False, 6: False, 8: True}
    tags = lambda *t: spark.createDataFrame([(x,) for x in t], "tag string")
    assert {r["rule_id"]: r["detail"] for r in E.check_tags(sound, tags("t1", "t9", "t8"), tags("t1")).collect()} == {"not_in_router": "t2", "router_without_evidence": "t8, t9", "router_without_frame": "t8, t9"}
    stats = E.card_stats(sound, "2026-02-15", 30).first()
    assert (stats["cards"], stats["price_cards"], stats["stale_cards"], stats["future_cards"]) == (3, 1, 2, 0)


def test_files_and_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n## `one`\nx\ny\n## `two`\n| `tag` | z |\n")
    read = S.read_lines(spark, f"{tmp_path}/a.md")
    assert read.count() == 6
    assert [(r["heading"], r["body"]) for r in S.md_sections(read).orderBy("ord").collect()] == [("`one`", "x\ny"), ("`two`", "| `tag` | z |")]
    assert {r["tag"] for r in S.md_tags(read, S.FRAME_TAG).collect()} == {"one", "two"} and {r["tag"] for r in S.md_tags(read, S.ROUTER_TAG).collect()} == {"tag"}


def test_manifest(spark):
    text = json.dumps({"fields": {"evidence_freshness_days": {"value": 30, "source": "curated"}, "x": {"value": "a", "source": ""}, "channels_shipped": {"value": ["a", "b"], "source": "code"}, "channels_target": {"value": ["b"], "source": "code"}}})
    fields = S.manifest_fields(spark.createDataFrame([("m", text)], "file string, value string"))
    assert E.freshness_days(fields) == 30 and E.freshness_days(fields, 7) == 7
    assert {(r["path"], r["rule_id"]) for r in E.check_manifest(fields).collect()} == {("evidence_freshness_days", "curated_without_check"), ("x", "no_source")}
    assert {r["rule_id"]: r["detail"] for r in E.check_lists(fields, ["a"]).collect()} == {"channels_differ": "a, b", "shipped_and_target": "b"}
    new = spark.createDataFrame([("x", '"a"'), ("y", "1")], "field string, value string")
    assert [(r["field"], r["old"], r["new"]) for r in E.sync_fields(fields, new).collect()] == [("y", None, "1")]
    assert E.upsert_fields(fields, new).count() == 5


def test_json_recovery_and_receipts(spark):
    df = spark.createDataFrame([(1, '```json\n{"a": 1}\n```'), (2, 'Sure: {"a": 2} done'), (3, "none"), (4, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(F.variant_get(S.recover_json(F.col("t")), "$.a", "int")).collect()] == [1, 2, None, None]
    r = S.with_receipt(spark.createDataFrame([("é",)], "body string"), "body")
    assert r.first()["size_bytes"] == 2 and S.check_receipt(r, "body").count() == 0 and S.check_receipt(r.withColumn("sha256", F.lit("0")), "body").count() == 1


def test_lines_and_bundles(spark):
    ls = lines(spark, ["- the channel list is mail", "  and fax", "we will ship fax soon"])
    assert [r["logical"] for r in E.logical_lines(ls).orderBy("line").collect()] == ["- the channel list is mail and fax", "- the channel list is mail and fax", "we will ship fax soon"]
    assert {r["word"] for r in E.check_channel_lines(ls, ["mail"], ["the", "channel", "list", "is"]).collect()} == set()
    assert [(r["line"], r["field"]) for r in E.check_target_claims(ls, {"fax": r"\bfax\b"}, r"\bwill\b", r"\bno\b").collect()] == [(2, "fax")]
    req = spark.createDataFrame([(1, "blog", "cost", "t1")], "request_id int, channel string, angle string, tag string")
    sec = spark.createDataFrame([("base", None, 1, "BASE"), ("channel", "blog", 2, "CH"), ("angle", "other", 3, "NO"), ("frame", "t1", 4, "FR")], "kind string, key string, ord int, body string")
    cards = spark.createDataFrame([("t1", 2, "{2}"), ("t1", 1, "{1}"), ("t2", 1, "{x}")], "tag string, line int, json string")
    assert E.bundles(req, sec, cards).first()["text"] == "BASE\n\nCH\n\nFR\n\n{1}\n\n{2}"


def test_texts_of_bundles_are_not_shuffled(spark):
    # each card went through a shuffle once for each request of its tag
    requests = spark.createDataFrame([(1, "c", "a", "t"), (2, "c", None, "u"), (3, "x", "x", "x"), (4, "c", "a", "t"), (4, "c", "z", "u")], "request_id long, channel string, angle string, tag string")
    sections = spark.createDataFrame([("channel", "c", 1, "C"), ("angle", "a", 2, "A"), ("frame", "u", 3, "U"), ("base", None, 0, "B")], "kind string, key string, ord int, body string")
    cards = spark.createDataFrame([("t", 2, "two"), ("t", 1, "one")], "tag string, line long, json string")
    got = E.bundles(requests, sections, cards)
    assert {r["request_id"]: r["text"].split("\n\n") for r in got.collect()} == {1: ["B", "C", "A", "one", "two"], 2: ["B", "C", "U"], 3: ["B"], 4: ["B", "B", "C", "C", "A", "U", "one", "two"]}
    assert "explode(map_from_arrays" not in got._jdf.queryExecution().toString()


def test_evidence_bundles_hold_every_part(spark, tmp_path):
    # parts of a size up to 45 were left out
    from pagewarrant import plans

    spark.createDataFrame([(1, "O", "1-URGENT", 51), (2, "F", "5-LOW", 40)], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "big", "Brand#11", 46), (5, "small", "Brand#11", 1), (6, "none", "Brand#11", None)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["request_id"]: r["text"].split("\n\n") for r in plans.QUERIES["evidence_bundles"](spark, str(tmp_path)).collect()}
    assert got == {1: ["base", "channel O", "angle 1-URGENT", '{"p_name":"small"}', '{"p_name":"none"}', '{"p_name":"big"}'], 2: ["base", "channel F", "angle 5-LOW"]}
    assert "p_size" not in plans.ORACLE_SQL["evidence_bundles"]
