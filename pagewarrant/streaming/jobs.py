"""Job events and generation frames: batch folds and their streaming twins.

The state machine is accepted -> processing -> completed or failed; what does
not fit a job's state is ignored.  ``job_events`` are rows ``job_id,
request_hash, event, ts, payload, error_code, retryable``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which states an event may leave, and where it leads.
LEAVES = {"processing": ["accepted"], "complete": ["processing"], "fail": ["accepted", "processing"]}
LEADS = {"accept": "accepted", "processing": "processing", "complete": "completed", "fail": "failed"}
JOB_STATE = "job_id string, request_hash string, status string, created_at timestamp, updated_at timestamp, output string, error_code string, retryable boolean"


def accept_jobs(events: DataFrame) -> DataFrame:
    """Each accept with its outcome: new (first of its id), replay (same hash as the first), conflict."""
    first = Window.partitionBy("job_id").orderBy("ts", "request_hash")
    seen = events.where("event = 'accept'").withColumn("n", F.row_number().over(first)).withColumn("own", F.first("request_hash").over(first))
    return seen.select("job_id", "request_hash", "ts", F.when(F.col("n") == 1, "new").when(F.col("request_hash") == F.col("own"), "replay").otherwise("conflict").alias("outcome"))


def _step(state: Column, e: Column) -> Column:
    """The state after one event; ``state`` is a struct of JOB_STATE's columns but the id."""
    status = state["status"]
    ok = F.when(e["event"] == "accept", status.isNull())
    for event, froms in LEAVES.items():
        ok = ok.when(e["event"] == event, status.isin(froms))
    ok = F.coalesce(ok.otherwise(False), F.lit(False))
    to = F.element_at(F.create_map(*[F.lit(x) for kv in LEADS.items() for x in kv]), e["event"])
    keep = lambda new, old: F.when(ok, new).otherwise(old)
    return F.struct(
        keep(F.coalesce(state["request_hash"], e["request_hash"]), state["request_hash"]).alias("request_hash"),
        keep(to, status).alias("status"),
        keep(F.coalesce(state["created_at"], e["ts"]), state["created_at"]).alias("created_at"),
        keep(e["ts"], state["updated_at"]).alias("updated_at"),
        keep(F.when(e["event"] == "complete", e["payload"]), state["output"]).alias("output"),
        keep(F.when(e["event"] == "fail", e["error_code"]), state["error_code"]).alias("error_code"),
        keep(F.when(e["event"] == "fail", F.coalesce(e["retryable"], F.lit(False))), state["retryable"]).alias("retryable"),
    )


def fold_jobs(events: DataFrame) -> DataFrame:
    """``job_state``: the fold of each job's events in order of time (ties: accept, processing, complete, fail)."""
    order = F.array_position(F.array(*map(F.lit, LEADS)), F.col("event"))
    one = F.struct(F.col("ts"), order.alias("o"), "event", "request_hash", F.col("payload").cast("string").alias("payload"), "error_code", "retryable")
    fields = [f.split() for f in JOB_STATE.split(", ")[1:]]
    start = F.struct(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])
    jobs = events.where(F.col("event").isin(list(LEADS))).groupBy("job_id").agg(F.sort_array(F.collect_list(one)).alias("e"))
    return jobs.select("job_id", F.aggregate("e", start, _step).alias("s")).select("job_id", "s.*").where("status is not null")


def expire_interrupted(state: DataFrame, now: Column) -> DataFrame:
    """Jobs found processing after a restart become failed and may be retried."""
    cut = F.col("status") == "processing"
    return state.withColumns(
        {
            "status": F.when(cut, "failed").otherwise(F.col("status")),
            "error_code": F.when(cut, "PROVIDER_INTERRUPTED").otherwise(F.col("error_code")),
            "retryable": F.when(cut, True).otherwise(F.col("retryable")),
            "updated_at": F.when(cut, now).otherwise(F.col("updated_at")),
        }
    )


def pending_jobs(state: DataFrame) -> DataFrame:
    return state.where("status = 'accepted'").orderBy("created_at", "job_id")


def check_terminal(state: DataFrame) -> DataFrame:
    """Violations: outputs only on completed jobs, errors only on failed ones, both where due."""
    error = F.col("error_code").isNotNull() & F.col("retryable").isNotNull()
    none = F.col("error_code").isNull() & F.col("retryable").isNull()
    ok = F.when(F.col("status") == "completed", F.col("output").isNotNull() & none).when(F.col("status") == "failed", F.col("output").isNull() & error).otherwise(F.col("output").isNull() & none)
    return state.where(~ok).select(F.col("job_id").alias("doc_id"), F.lit("terminal").alias("rule_id"), F.col("status").alias("path"))


def job_status(state: DataFrame) -> DataFrame:
    """The public view: a result with size and digest if completed, an error if failed."""
    result = F.when(F.col("status") == "completed", F.struct(F.octet_length("output").alias("size_bytes"), F.sha2("output", 256).alias("sha256")))
    error = F.when(F.col("status") == "failed", F.struct(F.col("error_code").alias("code"), "retryable"))
    return state.select("job_id", "status", "created_at", "updated_at", result.alias("result"), error.alias("error"))


def fold_stream(events: DataFrame, checkpoint_state: str = JOB_STATE) -> DataFrame:
    """Streaming twin of ``fold_jobs``: state per job, a row whenever it changes."""
    names = [f.split()[0] for f in JOB_STATE.split(", ")][1:]
    order = {e: i for i, e in enumerate(LEADS)}

    def fold(key, frames, state):
        now = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names)
        rows = pd.concat(list(frames))
        rows = rows[rows["event"].isin(LEADS)].assign(o=lambda d: d["event"].map(order)).sort_values(["ts", "o"])
        changed = False
        for r in rows.to_dict("records"):
            event = r["event"]
            if not (now["status"] is None if event == "accept" else now["status"] in LEAVES[event]):
                continue
            changed = True
            now["request_hash"] = now["request_hash"] or r["request_hash"]
            now["status"], now["updated_at"] = LEADS[event], r["ts"].to_pydatetime()
            now["created_at"] = now["created_at"] or r["ts"].to_pydatetime()
            if event == "complete":
                now["output"] = r["payload"]
            if event == "fail":
                now["error_code"], now["retryable"] = r["error_code"], bool(r["retryable"])
        state.update(tuple(now[n] for n in names))
        if changed:
            yield pd.DataFrame([{"job_id": key[0], **now}])

    return events.groupBy("job_id").applyInPandasWithState(fold, JOB_STATE, ", ".join(JOB_STATE.split(", ")[1:]), "update", "NoTimeout")


def assemble_frames(frames: DataFrame, max_bytes: int = 512 * 1024) -> DataFrame:
    """One row per request: content of its frames in order and a status.

    Statuses, first that holds: error, after_terminal, unexpected (thinking or
    tool calls), oversized, incomplete, ok.  ``frames`` are rows ``request_id,
    seq, content, done, error, thinking, tool_calls``.
    """
    by = frames.groupBy("request_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "").alias("content"),
        F.bool_or(F.col("error").isNotNull()).alias("error"),
        F.bool_or((F.coalesce("thinking", F.lit("")) != "") | (F.coalesce("tool_calls", F.lit("")).isin("", "[]") == False)).alias("odd"),  # noqa: E712
        F.min(F.when(F.col("done"), F.col("seq"))).alias("end"),
        F.max("seq").alias("last"),
    )
    status = (
        F.when(F.col("error"), "error").when(F.col("last") > F.col("end"), "after_terminal").when(F.col("odd"), "unexpected").when(F.octet_length("content") > max_bytes, "oversized").when(F.col("end").isNull(), "incomplete").otherwise("ok")
    )
    return by.select("request_id", F.when(status == "ok", F.col("content")).alias("content"), status.alias("status"))


def stalled(frames: DataFrame, gap_s: int = 300, deadline_s: int = 7200) -> DataFrame:
    """Requests whose frames pause longer than a gap, or last longer than a deadline: request_id, reason."""
    before = F.lag("ts").over(Window.partitionBy("request_id").orderBy("ts"))
    pause = frames.select("request_id", "ts", (F.unix_micros(F.col("ts")) - F.unix_micros(before)).alias("pause"))
    by = pause.groupBy("request_id").agg(F.max("pause").alias("pause"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("length"))
    reason = F.when(F.col("pause") > gap_s * 1_000_000, "no_progress").when(F.col("length") > deadline_s * 1_000_000, "deadline")
    return by.select("request_id", reason.alias("reason")).where("reason is not null")
