"""The idle timer to its look, as a stream.

Activity is first reduced to one row per session and timeout-wide cell of time, which leaves when the watermark passes the cell: a busy session
is a few rows before its shuffle. Two activities of a cell have no stop between them, so the timer may walk on cells, as the batch rule does. What it
keeps of a session is a handful of numbers; no built-in operator carries such a walk across batches, so it is a keyed state with an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from fleetlens import schemas as S
from fleetlens.functions.clock import SECOND, micros
from fleetlens.operators.lifecycle import idle_sessions

_POLL = S.IDLE_POLL_S * SECOND
_STATE = "t0 bigint, active bigint, n bigint, stopped boolean"
_STOPS = "session_key bigint, t0 bigint, stop bigint, activities bigint"


def _stop_after(t0: int, active: int, timeout: int) -> int:
    """The first look more than ``timeout`` after the last activity."""
    return t0 + ((active + timeout - t0) // _POLL + 1) * _POLL


class IdleTimer(StatefulProcessor):
    """The timer of a session, which walks over its cells in order. All its times are microseconds."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("timer", _STATE)

    def _closed(self, due: int) -> int:
        """Milliseconds at which every cell that could hold an activity up to ``due`` has come."""
        return (due // self.timeout + 1) * self.timeout // 1000 + 1

    def _stopped(self, key: tuple, t0: int, stop: int, n: int) -> pd.DataFrame:
        return pd.DataFrame({"session_key": [key[0]], "t0": [t0], "stop": [stop], "activities": [n]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        t0, active, n, stopped = self.state.get() if self.state.exists() else (None, None, 0, False)
        if stopped:
            return
        for cell in pd.concat(list(rows)).sort_values("at").itertuples():
            if t0 is None:
                t0 = active = int(cell.first_row)
            if pd.isna(cell.first):
                continue
            due = _stop_after(t0, active, self.timeout)
            if cell.first > due:
                stopped = True
                break
            # A running query counts as active at each look it spans: the last one strictly before its end.
            last_look = t0 + (-((t0 - int(cell.last_end)) // _POLL) - 1) * _POLL
            active, n = max(active, int(cell.last), last_look), n + int(cell.n)
        due = _stop_after(t0, active, self.timeout)
        self.state.update((t0, active, n, stopped))
        if stopped:
            yield self._stopped(key, t0, due, n)
        else:
            self.handle.registerTimer(self._closed(due))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        t0, active, n, stopped = self.state.get()
        due = _stop_after(t0, active, self.timeout)
        if stopped or expiredTimerInfo.getExpiryTimeInMs() < self._closed(due):  # a timer from before the last activity
            return
        self.state.update((t0, active, n, True))
        yield self._stopped(key, t0, due, n)


def stream_idle_stops(activity: DataFrame, timeout_s: int, delay: str) -> DataFrame:
    """When the idle timer stops each session, once the watermark has passed all that could have kept it; run it in append mode.

    ``activity(session_key, start_ts, end_ts, control)`` and the rule are those of ``idle_sessions``, and so are the results: started_at, stopped_at and the
    activities up to the stop. Rows with a control value only set the start. A session stops once; what it does later is ignored, so its few
    numbers are kept. Sessions the watermark hasn't passed are in ``open_idle_stops``. The timeout is at least a second. Keyed state needs the
    RocksDB state store, which ``run.append_to_files`` sets if told.
    """
    counts = F.col("control").isNull()
    start, end = micros(F.col("start_ts")), micros(F.col("end_ts"))
    cells = (
        activity.withWatermark("start_ts", delay)
        .groupBy("session_key", F.window("start_ts", f"{timeout_s} seconds").alias("cell"))
        .agg(
            F.min(start).alias("first_row"),
            F.min(F.when(counts, start)).alias("first"),
            F.max(F.when(counts, start)).alias("last"),
            F.max(F.when(counts, end)).alias("last_end"),
            F.count_if(counts).alias("n"),
        )
        .select("session_key", F.window_time("cell").alias("at"), "first_row", "first", "last", "last_end", "n")
    )
    stops = cells.groupBy("session_key").transformWithStateInPandas(IdleTimer(timeout_s * SECOND), _STOPS, "append", "EventTime")
    return stops.select("session_key", F.timestamp_micros("t0").alias("started_at"), F.timestamp_micros("stop").alias("stopped_at"), "activities")


def open_idle_stops(reported: DataFrame, activity: DataFrame, timeout_s: int, observed_until) -> DataFrame:
    """The sessions of ``activity``, the stream's input in batch, that the stream hasn't reported, with their stop if there is one by then."""
    rest = activity.join(reported.select("session_key"), "session_key", "left_anti")
    found = idle_sessions(rest, timeout_s, observed_until)
    return found.select("session_key", "started_at", "stopped_at", (F.col("activities") - F.col("after_stop")).alias("activities"))
