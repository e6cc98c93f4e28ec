"""Streaming forms of the batch operators, built from the same expressions.

Event times must be TIMESTAMP (with time zone): watermarks don't take TIMESTAMP_NTZ.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas as S
from fleetlens.functions.clock import SECOND, micros, moment, plus_seconds
from fleetlens.operators.lifecycle import fold_lifecycle
from fleetlens.operators.resolution import resolve_against_snapshot
from fleetlens.operators.transitions import prune_cutoff


def stream_registry(events: DataFrame, last_event: bool = False) -> DataFrame:
    """The end state per session, kept up to date; run it in update mode.

    State is one row per session whatever the order of arrival: late callbacks count, so there is no watermark. With ``last_event`` the
    time of a session's last event comes too, for retention where the rows are kept.
    """
    return fold_lifecycle(events, last_event)


def is_expired(now: datetime, age_s: int) -> Column:
    """FAILED and FINISHED rows of ``stream_registry`` whose last event is ``age_s`` or longer ago."""
    old = F.col("last_event") <= moment(prune_cutoff(now, age_s), T.TimestampType())
    return F.coalesce(F.col("state").isin(*S.TERMINAL_STATES) & old, F.lit(False))


def stream_launch_timeouts(launches: DataFrame, signals: DataFrame, timeout_s: int, delay: str, salts: int = 1) -> DataFrame:
    """Launches with neither callback nor non-zero exit by their deadline, once event time has passed it.

    ``launches(session_key, launch_id, ts)``, ``signals(session_key, ts)``. Signals are first reduced to the
    last one in each timeout-wide cell and the first one in the cell after it, which is all a
    launch in that cell can need. So a launch meets one row, not every signal of its session. A
    timeout is reported when the watermark passes the end of that next cell; ``open_launch_timeouts`` has the rest. Where one
    session launches very often, its launches can be spread over ``salts`` tasks, with its few signal rows repeated for each.
    """
    width, step = f"{2 * timeout_s} seconds", f"{timeout_s} seconds"
    middle = plus_seconds(F.col("cells.start"), timeout_s)
    at = micros(F.col("ts"))
    nearby = (
        signals.withWatermark("ts", delay)
        .select("session_key", "ts", F.window("ts", width, step).alias("cells"))
        .groupBy(F.col("session_key").alias("_key"), F.col("cells").alias("_cells"))
        .agg(
            F.max(F.when(F.col("ts") < middle, at)).alias("last_here"),
            F.min(F.when(F.col("ts") >= middle, at)).alias("first_next"),
        )
        .withColumn("_salts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    )
    # The cell carries the watermark from here on; a stream has one event time column.
    placed = (
        launches.withWatermark("ts", delay)
        .select("session_key", "launch_id", "ts", F.window("ts", width, step).alias("cells"))
        .where(F.col("ts") < middle)
        .select("session_key", "launch_id", at.alias("launched"), "cells")
        .withColumn("_salt", F.pmod(F.xxhash64("launch_id"), F.lit(salts)))
    )
    deadline = F.col("launched") + timeout_s * SECOND
    return (
        placed.join(
            nearby,
            (F.col("session_key") == F.col("_key"))
            & (F.col("_salt") == F.col("_salts"))
            & (F.col("cells") == F.col("_cells"))
            & ((F.col("last_here") >= F.col("launched")) | (F.col("first_next") <= deadline)),
            "left_outer",
        )
        .where(F.col("_key").isNull())
        .select(
            "session_key",
            "launch_id",
            F.timestamp_micros("launched").alias("launched_at"),
            F.timestamp_micros(deadline).alias("failed_at"),
        )
    )


def open_launch_timeouts(reported: DataFrame, launches: DataFrame, signals: DataFrame, timeout_s: int, watermark: datetime) -> DataFrame:
    """What ``stream_launch_timeouts`` would report of its input next, if nothing came any more.

    ``reported`` is what it has reported up to ``watermark``; ``launches`` and ``signals`` are its input in batch, of which
    only what lies within two timeouts of the watermark, or after it, is used.
    """
    recent = F.col("ts") >= moment(watermark - timedelta(seconds=2 * timeout_s), launches.schema["ts"].dataType)
    late = stream_launch_timeouts(launches.where(recent), signals.where(recent), timeout_s, "0 seconds")
    return late.join(reported.select("launch_id"), "launch_id", "left_anti").select(*late.columns)


def _spans(activity: DataFrame, timeout_s: int) -> DataFrame:
    running = F.greatest(micros(F.col("end_ts")) - micros(F.col("start_ts")), F.lit(0))
    gap = F.concat((running + timeout_s * SECOND).cast("string"), F.lit(" microseconds"))
    return (
        activity.groupBy("session_key", F.session_window("start_ts", gap).alias("span"))
        .agg(F.count(F.lit(1)).alias("activities"))
        .select(
            "session_key",
            F.col("span.start").alias("active_from"),
            F.col("span.end").alias("idle_at"),
            "activities",
        )
    )


def stream_idle_sessions(activity: DataFrame, timeout_s: int, delay: str) -> DataFrame:
    """Spans of activity, closed once nothing was active for the timeout; run it in append mode.

    ``activity(session_key, start_ts, end_ts, control)``. A span ends a timeout after its last activity
    ended, up to one 60 s look earlier than the exact batch rule. Spans the watermark hasn't passed are in ``open_idle_sessions``. Where
    the session merges windows before the shuffle (``fleetlens.session``), a busy session is a few rows per task there.
    """
    return _spans(activity.where(F.col("control").isNull()).withWatermark("start_ts", delay), timeout_s)


def open_idle_sessions(reported: DataFrame, activity: DataFrame, timeout_s: int) -> DataFrame:
    """The spans of ``activity``, the stream's input in batch, that come after those ``reported`` of each session."""
    last = reported.groupBy("session_key").agg(F.max("idle_at").alias("_reported"))
    active = activity.where(F.col("control").isNull())
    rest = active.join(last, "session_key", "left").where(F.col("_reported").isNull() | (F.col("start_ts") > F.col("_reported")))
    return _spans(rest.drop("_reported"), timeout_s)


def stream_request_resolution(requests: DataFrame, sessions: DataFrame, salts: int = 1) -> DataFrame:
    """Each request against the current sessions, one row per token; no state.

    Each batch reads ``sessions`` again. With one salt and the bucketed table of ``write_token_lookup`` it isn't shuffled.
    """
    return resolve_against_snapshot(requests, sessions, salts)
