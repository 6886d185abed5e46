"""Streams of frames and accepts against the batch folds."""

import datetime as dt
import os

import pandas as pd
import pytest

from pagewarrant.streaming import frames as S
from pagewarrant.streaming import jobs as J

FRAMES = "request_id string, seq long, ts timestamp, content string, done boolean, error string, thinking string, tool_calls string"
T0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k) for k in (S.PROVIDER[0], "spark.sql.shuffle.partitions")}
    spark.conf.set(*S.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


whole = pytest.mark.skipif(not os.environ.get("STREAM_TESTS"), reason="minutes of query starts; set STREAM_TESTS=1")


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class _Map(dict):
    def containsKey(self, k):
        return k in self

    def updateValue(self, k, v):
        self[k] = v

    def iterator(self):
        return iter(self.items())


class _Handle:
    """State of one key and its timers, as a store would keep them."""

    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return _Map()

    def getValueState(self, *_):
        return _Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Info:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def _play(batches, watermarks):
    """What a request's frames (seq, seconds, content, done, error) tell, with timers that go off as the watermark passes."""
    handle, told = _Handle(), []
    request = S._Frames(300_000, 7_200_000, 50)
    request.init(handle)
    for frames, watermark in zip(batches, watermarks):
        if frames:
            rows = pd.DataFrame([{"seq": q, "ms": s * 1000, "content": c, "done": d, "error": e, "odd": False} for q, s, c, d, e in frames])
            told += [tuple(x) for out in request.handleInputRows(("r",), iter([rows]), None) for x in out[["content", "status"]].itertuples(index=False)]
        for at in sorted(t for t in handle.timers if t <= watermark * 1000):
            handle.timers.discard(at)
            told += [tuple(x) for out in request.handleExpiredTimer(("r",), None, _Info(at)) for x in out[["content", "status"]].itertuples(index=False)]
    return told, request, handle


@pytest.mark.parametrize(
    ("batches", "watermarks", "want"),
    [
        ([[(0, 0, "a", False, None), (1, 1, "b", True, None)]], [0], [("ab", "ok")]),
        ([[(1, 1, "b", True, None)], [(0, 0, "a", False, None)]], [0, 0], [("ab", "ok")]),  # late
        ([[(0, 0, "a", False, None)], [(0, 0, "z", False, None), (1, 2, "b", True, None)], [(1, 2, "b", True, None)]], [0, 0, 0], [("ab", "ok")]),  # repeated
        ([[(0, 0, "a", False, None)], []], [0, 301], [(None, "no_progress")]),
        ([[(0, 0, "a", False, None)], [(1, 250, "b", False, None)], []], [0, 301, 540], []),  # progress moves the timer
        ([[(0, 0, "a", False, None)], [], [(1, 400, "b", True, None)]], [0, 301, 400], [(None, "no_progress")]),  # told once
        ([[(k, k * 200, "", False, None)] for k in range(37)] + [[]], [*[k * 200 for k in range(37)], 7201], [(None, "deadline")]),
        ([[(0, 0, "a", True, None), (1, 0, "b", False, None)]], [0], [(None, "after_terminal")]),
        ([[(0, 0, "a", False, "boom")]], [0], [(None, "error")]),
        ([[(0, 0, "a" * 51, True, None)]], [0], [(None, "oversized")]),
    ],
)
def test_one_request(batches, watermarks, want):
    told, request, handle = _play([*batches, []], [*watermarks, watermarks[-1]])
    assert told == want
    if told:
        assert not request.parts  # nothing is kept of what was told but its mark
        _, request, handle = _play([*batches, []], [*watermarks, 10_000])
        assert not request.clock.exists() and not handle.timers


def _run(spark, folder, batches, schema, build):
    """Feeds batches one by one and returns the rows of each."""
    seen = []
    spark.createDataFrame([], schema).write.parquet(f"{folder}/in")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(200)
        seen.append(sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), key=repr))
    return seen


def _frame(request, seq, s, content="x", done=False, error=None, thinking=None, tools=None):
    return (request, seq, T0 + dt.timedelta(seconds=s), content, done, error, thinking, tools)


@whole
def test_frames(rocks, tmp_path):
    one = [_frame("a", 0, 0, "A"), _frame("a", 2, 2, "C", True), _frame("b", 0, 0, "B"), _frame("c", 0, 0, "e", error="boom"), _frame("d", 0, 0, "d", True, thinking="hm"), _frame("f", 0, 0, "f"), _frame("f", 1, 1, "g", True), _frame("h", 0, 0, "h" * 99, True)]
    two = [_frame("a", 1, 1, "B"), _frame("a", 0, 0, "other"), _frame("f", 0, 3, "again"), _frame("e", 0, 4, "e"), _frame("e", 1, 5, "f", True), _frame("e", 2, 6, "g")]
    late = [_frame("z", 0, 500, "z")]
    end = [_frame("z", 1, 9000, "z"), _frame("b", 1, 9000, "late", True)]
    seen = _run(rocks, str(tmp_path), [one, two, late, end, [_frame("y", 0, 30_000)]], FRAMES, lambda s: S.frame_stream(s, gap_s=300, deadline_s=7200, late_s=60, max_bytes=50))
    told = {r[0]: (r[1], r[2]) for r in seen[-1] if r[0] not in ("y", "z")}
    assert told == {"a": ("ABC", "ok"), "b": (None, "no_progress"), "c": (None, "error"), "d": (None, "unexpected"), "e": (None, "after_terminal"), "f": ("fg", "ok"), "h": (None, "oversized")}
    assert len(seen[-1]) == len({(r[0]) for r in seen[-1]})  # each once, whatever came later
    assert {r[0] for r in seen[0]} == {"c", "d", "f", "h"} and {r[0] for r in seen[1]} - {r[0] for r in seen[0]} == {"a", "e"} and ("b", None, "no_progress") in seen[3]
    # the batch fold says the same of all that ended
    fold = {r["request_id"]: r["status"] for r in J.assemble_frames(rocks.createDataFrame([*one, *[f for f in two if f[3] not in ("other", "again")]], FRAMES), 50).collect()}
    assert {k: v for k, v in fold.items() if v != "incomplete"} == {k: v[1] for k, v in told.items() if k != "b"} and fold["b"] == "incomplete"


@whole
def test_accepts(rocks, tmp_path):
    kind = "job_id string, request_hash string, event string, ts timestamp"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("a", "h", "accept", at(0)), ("a", "h", "accept", at(1)), ("b", "x", "fail", at(0))], [("a", "k", "accept", at(2)), ("b", "y", "accept", at(3)), ("b", "y", "accept", at(4)), ("a", "h", "accept", at(5))]]
    seen = _run(rocks, str(tmp_path), batches, kind, S.accept_stream)
    want = J.accept_jobs(rocks.createDataFrame([r for b in batches for r in b], kind)).select("job_id", "request_hash", "ts", "outcome").collect()
    assert seen[-1] == sorted((tuple(r) for r in want), key=repr) and [r[3] for r in seen[0]] == ["new", "replay"]
