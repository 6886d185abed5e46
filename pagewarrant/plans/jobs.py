"""Queries over events as job events: a user is a job, its clicks and purchases move it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.texts import check_receipt, recover_json, with_receipt
from ..streaming import jobs as J


def _job_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_id") % 7 == 0, "fail").when(F.col("event_id") % 5 == 0, "complete").when(F.col("event_id") % 3 == 0, "processing").otherwise("accept")
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), F.sha2(F.col("event_type"), 256).alias("request_hash"), kind.alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("payload"),
        F.when(F.col("event_id") % 2 == 0, "TIMEOUT").otherwise("BAD_REQUEST").alias("error_code"), (F.col("event_id") % 2 == 0).alias("retryable"), "event_id",
    )


def job_accepts(spark, sf_dir):
    return J.accept_jobs(_job_events(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("n_jobs"))


def job_states(spark, sf_dir):
    return J.job_status(J.fold_jobs(_job_events(spark, sf_dir))).select("job_id", "status", F.col("result.sha256").alias("sha256"), F.col("error.code").alias("error_code"))


def stalled_users(spark, sf_dir):
    """Users whose events pause longer than a day or span more than thirty."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    return J.stalled(e, 86_400, 30 * 86_400)


def event_props(spark, sf_dir):
    """Props of events as recovered JSON objects: events, sum and largest of a key by type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.variant_get(recover_json(F.col("props")), "$.k", "int")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def prop_receipts(spark, sf_dir):
    """Size and digest of each event's props."""
    e = with_receipt(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props"), "props")
    return e.select("event_id", F.col("size_bytes").cast("long").alias("size_bytes"), "sha256")


def stale_receipts(spark, sf_dir):
    """Events whose props are not what the receipt of the event before them declares."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    declared = with_receipt(e, "props").select((F.col("event_id") + 1).alias("event_id"), "size_bytes", "sha256")
    return check_receipt(e.join(declared, "event_id", "left"), "props").select("event_id", F.col("size_bytes").cast("long").alias("declared_bytes"))


QUERIES = {f.__name__: f for f in (job_accepts, job_states, stalled_users, event_props, prop_receipts, stale_receipts)}
_E = """e AS (SELECT user_id::VARCHAR AS job_id, sha256(event_type) AS request_hash, ts, CASE WHEN event_id % 7 = 0 THEN 'fail' WHEN event_id % 5 = 0 THEN 'complete' WHEN event_id % 3 = 0 THEN 'processing' ELSE 'accept' END AS event FROM events)"""
ORACLE_SQL = {
    "event_props": "SELECT event_type, count(*) AS n, sum((props::JSON->>'$.k')::INT)::BIGINT AS sum_k, max((props::JSON->>'$.k')::INT) AS max_k FROM events GROUP BY 1",
    "stale_receipts": "SELECT e.event_id, strlen(d.props) AS declared_bytes FROM events e LEFT JOIN events d ON d.event_id = e.event_id - 1 WHERE d.props IS NULL OR e.props IS NULL OR d.props <> e.props",
    "prop_receipts": "SELECT event_id, strlen(props) AS size_bytes, sha256(props) AS sha256 FROM events",
    "job_accepts": f"""WITH {_E}, s AS (SELECT job_id, request_hash, row_number() OVER w AS n, first_value(request_hash) OVER w AS own FROM e WHERE event = 'accept' WINDOW w AS (PARTITION BY job_id ORDER BY ts, request_hash))
SELECT CASE WHEN n = 1 THEN 'new' WHEN request_hash = own THEN 'replay' ELSE 'conflict' END AS outcome, count(*) AS n, count(DISTINCT job_id) AS n_jobs FROM s GROUP BY 1""",
    "stalled_users": """WITH p AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS pause FROM events),
b AS (SELECT user_id, max(pause) AS pause, epoch_us(max(ts)) - epoch_us(min(ts)) AS len FROM p GROUP BY 1)
SELECT user_id AS request_id, CASE WHEN pause > 86400000000 THEN 'no_progress' ELSE 'deadline' END AS reason FROM b WHERE pause > 86400000000 OR len > 2592000000000""",
    "job_states": f"""WITH {_E.replace("ts, CASE", "ts, event_type AS payload, CASE WHEN event_id % 2 = 0 THEN 'TIMEOUT' ELSE 'BAD_REQUEST' END AS error_code, CASE")},
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, list_position(['accept', 'processing', 'complete', 'fail'], event), request_hash, payload, error_code) AS i FROM e),
a AS (SELECT job_id, min(i) AS i FROM n WHERE event = 'accept' GROUP BY 1),
x AS (SELECT n.job_id, min(n.i) AS i, arg_min(n.event, n.i) AS event, arg_min(n.error_code, n.i) AS error_code FROM n JOIN a USING (job_id) WHERE n.i > a.i AND n.event IN ('processing', 'fail') GROUP BY 1),
y AS (SELECT n.job_id, arg_min(n.event, n.i) AS event, arg_min(n.error_code, n.i) AS error_code, arg_min(n.payload, n.i) AS payload FROM n JOIN x USING (job_id) WHERE x.event = 'processing' AND n.i > x.i AND n.event IN ('complete', 'fail') GROUP BY 1)
SELECT a.job_id, CASE WHEN x.event = 'fail' OR y.event = 'fail' THEN 'failed' WHEN y.event = 'complete' THEN 'completed' WHEN x.event = 'processing' THEN 'processing' ELSE 'accepted' END AS status,
  CASE WHEN y.event = 'complete' THEN sha256(y.payload) END AS sha256, CASE WHEN x.event = 'fail' THEN x.error_code WHEN y.event = 'fail' THEN y.error_code END AS error_code FROM a LEFT JOIN x USING (job_id) LEFT JOIN y USING (job_id)""",
}
