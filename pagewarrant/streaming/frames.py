"""Generation frames and accepted requests as streams with state that ends.

Each request keeps its frames by number in a map, so repeated frames change
nothing and late ones still find their place.  Two event-time timers watch it: one
after the last frame, one after the first.  A request is told once, when its
terminal frame and all before it are there, when a frame carries an error,
or when a timer goes off; then its frames are dropped and its mark stays until
the deadline.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RESULT = "request_id string, content string, status string"
ACCEPTED = "job_id string, request_hash string, ts timestamp, outcome string"
#: The state store that maps, timers and expiry need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Frames(StatefulProcessor):
    def __init__(self, gap_ms: int, deadline_ms: int, max_bytes: int):
        self.gap, self.deadline, self.max_bytes = gap_ms, deadline_ms, max_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "seq long", "content string, bad string")
        # first and last time, number of the terminal frame (-1: not seen), greatest number, frames, whether told
        self.clock = handle.getValueState("clock", "first long, last long, terminal long, greatest long, n long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, terminal, greatest, n, told = self.clock.get() if self.clock.exists() else (None, None, -1, -1, 0, False)
        began, before = first, last
        for frame in (r for rows_ in rows for r in rows_.to_dict("records")):
            if told:
                break
            seq = int(frame["seq"])
            first = frame["ms"] if first is None else min(first, frame["ms"])
            last = frame["ms"] if last is None else max(last, frame["ms"])
            if self.parts.containsKey((seq,)):
                continue
            bad = "error" if frame["error"] is not None else "unexpected" if frame["odd"] else None
            self.parts.updateValue((seq,), (frame["content"] or "", bad))
            n, greatest = n + 1, max(greatest, seq)
            if frame["done"]:
                terminal = seq if terminal < 0 else min(terminal, seq)
        if first is not None and not told:
            if began != first:
                if began is not None:
                    self.handle.deleteTimer(began + self.deadline)
                self.handle.registerTimer(first + self.deadline)
            if before != last:
                if before is not None and before + self.gap != (began or 0) + self.deadline:
                    self.handle.deleteTimer(before + self.gap)
                self.handle.registerTimer(last + self.gap)
            held = dict(self.parts.iterator())
            out = self._status(held, terminal, greatest)
            told = out is not None
            if told:
                self.parts.clear()
            self.clock.update((first, last, terminal, greatest, n, told))
            if told:
                yield pd.DataFrame([{"request_id": key[0], "content": out[1], "status": out[0]}])

    def _status(self, held: dict, terminal: int, greatest: int) -> tuple[str, str | None] | None:
        """Status and content once nothing more is awaited."""
        bad = {v[1] for v in held.values()}
        if "error" in bad:
            return "error", None
        if terminal >= 0 and greatest > terminal:
            return "after_terminal", None
        if terminal < 0 or any((k,) not in held for k in range(terminal + 1)):
            return None
        content = "".join(held[(k,)][0] for k in range(terminal + 1))
        if "unexpected" in bad:
            return "unexpected", None
        return ("oversized", None) if len(content.encode()) > self.max_bytes else ("ok", content)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.clock.exists():
            return
        first, last, terminal, greatest, n, told = self.clock.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        over = at >= first + self.deadline
        if not told:
            yield pd.DataFrame([{"request_id": key[0], "content": None, "status": "deadline" if over else "no_progress"}])
        self.parts.clear()
        if over:
            self.clock.clear()
        else:
            self.clock.update((first, last, terminal, greatest, n, True))

    def close(self) -> None:
        pass


def frame_stream(frames: DataFrame, gap_s: int = 300, deadline_s: int = 7200, late_s: int = 60, max_bytes: int = 512 * 1024) -> DataFrame:
    """``request_id, content, status`` of each request, once (append mode).

    ``frames`` stream ``request_id, seq`` (from 0), ``ts, content, done, error, thinking, tool_calls``.  Statuses as in
    ``jobs.assemble_frames``, and ``no_progress`` or ``deadline`` where the watermark, ``late_s`` behind,
    passes a pause of ``gap_s`` after the last frame or ``deadline_s`` after the first.
    """
    odd = (F.coalesce("thinking", F.lit("")) != "") | ~F.coalesce("tool_calls", F.lit("")).isin("", "[]")
    own = frames.withWatermark("ts", f"{late_s} seconds").select("request_id", "seq", "ts", F.unix_millis("ts").alias("ms"), "content", F.coalesce("done", F.lit(False)).alias("done"), "error", odd.alias("odd"))
    return own.groupBy("request_id").transformWithStateInPandas(_Frames(gap_s * 1000, deadline_s * 1000, max_bytes), RESULT, "append", "EventTime")


class _Accepts(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "request_hash string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "request_hash"], kind="stable").to_dict("records"):
            if not self.first.exists():
                self.first.update((r["request_hash"],))
                outcome = "new"
            else:
                outcome = "replay" if self.first.get()[0] == r["request_hash"] else "conflict"
            out.append({"job_id": key[0], "request_hash": r["request_hash"], "ts": r["ts"], "outcome": outcome})
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def accept_stream(events: DataFrame, ttl_s: int = 7 * 86_400) -> DataFrame:
    """Each accept with its outcome (append mode): new, replay of the same hash, conflict; an id is forgotten ``ttl_s`` after it was new."""
    own = events.where("event = 'accept'").select("job_id", "request_hash", "ts")
    return own.groupBy("job_id").transformWithStateInPandas(_Accepts(ttl_s * 1000), ACCEPTED, "append", "ProcessingTime")
