import datetime as dt
import hashlib

from pyspark.sql import functions as F

from pagewarrant.operators import records as R
from pagewarrant.streaming import jobs as J


def test_records(spark):
    df = spark.createDataFrame(
        [(1, "ACME plumbing, LLC", " ", "x", ["A  b", "a b"], "owner@example.com", 1990), (2, "Bob's co", "t", "y", ["one"], "a@b.cd", 2100)],
        "id int, business_name string, trade string, city string, services array<string>, owner_email string, established int",
    )
    assert [(r["doc_id"], r["path"]) for r in R.check_fields(df, "id", ["business_name", "trade"]).collect()] == [(1, "trade")]
    assert [r["services_error"] for r in R.normalize_services(df).orderBy("id").collect()] == ["duplicate", None]
    assert [r["owner_email"] for r in R.scrub_placeholders(df).orderBy("id").collect()] == [None, "a@b.cd"]
    assert [r[0] for r in df.orderBy("id").select(R.display_name(F.col("business_name"))).collect()] == ["Acme Plumbing", "Bob'S"]
    assert [r[0] for r in df.orderBy("id").select(R.years_in_business(F.col("established"), F.lit(5), F.lit(2026))).collect()] == [36, 5]


def test_picks_follow_the_digest(spark):
    names = ["Acme", " acme ", "Other Co", ""]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(R.pick_section_order(F.col("n"))).collect()]
    want = [R.SECTION_ORDERS[int(hashlib.md5(n.strip().lower().encode()).hexdigest()[16:24], 16) % 3] if n.strip() else "default" for n in names]
    assert got == want


def test_reviews_and_claims(spark):
    kind = "id int, reviews array<struct<author:string,rating:double,date:string,platform:string,text:string>>, promises array<string>, ok boolean"
    good = ("a", 5.0, "d", "p", "t")
    df = spark.createDataFrame([(1, [good, ("TODO", 5.0, "d", "p", "t"), ("a", 6.0, "d", "p", "t"), (None, 1.0, "d", "p", "t")], ["Free Estimates always", ""], True), (2, None, None, None)], kind)
    got = [(len(r["reviews"]), r["dropped_reviews"]) for r in R.usable_reviews(df).orderBy("id").collect()]
    assert got == [(1, 3), (0, 0)]
    out = [r[0] for r in df.orderBy("id").select(R.unverified_claims(F.col("promises"), {"family_owned": F.col("ok")})).collect()]
    assert "Free Estimates" not in out[0] and "Family Owned" not in out[0] and "Owner Answers" in out[0] and {"Free Estimates", "Family Owned"} <= set(out[1])


def _events(spark):
    t = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    rows = [
        ("a", "h", "accept", t(1), None, None, None), ("a", "h", "accept", t(2), None, None, None), ("a", "g", "accept", t(3), None, None, None), ("a", None, "processing", t(4), None, None, None),
        ("a", None, "complete", t(5), "out", None, None), ("a", None, "fail", t(6), None, "X", True), ("b", "h", "accept", t(1), None, None, None), ("b", None, "complete", t(2), "out", None, None),
        ("b", None, "fail", t(3), None, "X", None), ("c", None, "processing", t(1), None, None, None), ("d", "h", "accept", t(1), None, None, None), ("d", None, "processing", t(2), None, None, None),
    ]
    return spark.createDataFrame(rows, "job_id string, request_hash string, event string, ts timestamp, payload string, error_code string, retryable boolean")


def test_jobs(spark):
    e = _events(spark)
    assert [r["outcome"] for r in J.accept_jobs(e).where("job_id = 'a'").orderBy("ts").collect()] == ["new", "replay", "conflict"]
    state = J.fold_jobs(e)
    got = {r["job_id"]: (r["status"], r["output"], r["error_code"], r["retryable"]) for r in state.collect()}
    assert got == {"a": ("completed", "out", None, None), "b": ("failed", None, "X", False), "d": ("processing", None, None, None)}
    assert J.check_terminal(state).count() == 0
    cut = {r["job_id"]: (r["status"], r["error_code"]) for r in J.expire_interrupted(state, F.current_timestamp()).collect()}
    assert cut["d"] == ("failed", "PROVIDER_INTERRUPTED") and cut["a"][0] == "completed"
    view = {r["job_id"]: r for r in J.job_status(state).collect()}
    assert view["a"]["result"]["size_bytes"] == 3 and view["b"]["error"]["code"] == "X" and view["d"]["result"] is None


def test_stream_twin(spark, tmp_path):
    e = _events(spark)
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = J.fold_stream(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("jobs_twin").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(J.fold_jobs(e).select("job_id", "status", "output", "error_code").collect())
    assert sorted(spark.table("jobs_twin").select("job_id", "status", "output", "error_code").collect()) == want


def test_frames_and_stalls(spark):
    rows = [("ok", 1, "a", False, None, None, None), ("ok", 2, "b", True, None, None, None), ("late", 1, "a", True, None, None, None), ("late", 2, "b", False, None, None, None), ("cut", 1, "a", False, None, None, None), ("err", 1, "", False, "boom", None, None), ("odd", 1, "a", True, None, "hm", None), ("big", 1, "x" * 50, True, None, None, None)]
    df = spark.createDataFrame(rows, "request_id string, seq int, content string, done boolean, error string, thinking string, tool_calls string")
    got = {r["request_id"]: (r["status"], r["content"]) for r in J.assemble_frames(df, 40).collect()}
    assert got == {"ok": ("ok", "ab"), "late": ("after_terminal", None), "cut": ("incomplete", None), "err": ("error", None), "odd": ("unexpected", None), "big": ("oversized", None)}
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("a", t(0)), ("a", t(400)), ("b", t(0)), ("b", t(100)), ("c", t(0))] + [("d", t(s)) for s in range(0, 7500, 200)], "request_id string, ts timestamp")
    assert {r["request_id"]: r["reason"] for r in J.stalled(df).collect()} == {"a": "no_progress", "d": "deadline"}
