"""Lifecycle log operators: end state, history, launch timers and idle timers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions.clock import SECOND, ceil_div, floor_div, micros, moment, plus_seconds
from fleetlens.functions.lifecycle import UNGUARDED, end_state, fold_facts, state_after
from fleetlens.plans.cells import CELL, SEQ_CELL, TIME_CELL, across, carry, cell_of, within


def fold_lifecycle(events: DataFrame, last_event: bool = False) -> DataFrame:
    """Final state, address and application id per session, and the time of its last event if asked: one aggregation, combined map-side."""
    latest = [F.max("ts").alias("last_event")] if last_event else []
    folded = events.groupBy("session_key").agg(*fold_facts("seq"), *latest)
    return folded.select("session_key", *end_state(), *(["last_event"] if last_event else []))


#: What a session's log up to some event comes to: enough to go on from there.
_SUMMARY = ["last_set", "last_health", "launch_failed", "last_app", "latest"]


def _log_of(events: DataFrame, created: DataFrame, width: int) -> DataFrame:
    key = "session_key"
    births = created.selectExpr(
        key,
        "cast(null AS bigint) AS seq",
        "created_at AS ts",
        f"'{S.CREATE}' AS kind",
        "cast(null AS string) AS address",
        "cast(null AS string) AS application_id",
        f"{-(1 << 62)}L AS _at",
    )
    log = events.select(key, "seq", "ts", "kind", "address", "application_id", F.col("seq").alias("_at")).unionByName(births)
    return log.withColumn(CELL, cell_of(F.col("_at"), width))


def _summed_up(summaries: DataFrame) -> DataFrame:
    """One summary per session from those of parts of its log."""
    return summaries.groupBy("session_key").agg(
        F.expr("max_by(last_set, last_set.at) AS last_set"),
        F.max("last_health").alias("last_health"),
        F.max("launch_failed").alias("launch_failed"),
        F.expr("max_by(last_app, last_app_at) AS last_app"),
        F.max("last_app_at").alias("last_app_at"),
        F.max("latest").alias("latest"),
    )


def _summaries(log: DataFrame) -> DataFrame:
    """One summary per (session, cell), combined map-side."""
    at = F.max(F.when(F.col("kind") == S.REGISTER, F.col("_at"))).alias("last_app_at")
    return log.groupBy("session_key", CELL).agg(*fold_facts("_at"), at, F.max("ts").alias("latest"))


def _changes(log: DataFrame, summaries: DataFrame) -> DataFrame:
    """The events that change a session's status, with where the status begins and, but for the last of a cell, ends."""
    key = "session_key"
    before = across(key)
    carried = summaries.select(
        key,
        CELL,
        F.last("last_set", ignorenulls=True).over(before).alias("last_set"),
        F.max("last_health").over(before).alias("last_health"),
        F.max("launch_failed").over(before).alias("launch_failed"),
        F.last("last_app", ignorenulls=True).over(before).alias("last_app"),
        F.max("latest").over(before).alias("_latest_before"),
        F.row_number().over(Window.partitionBy(key).orderBy(CELL)).alias("_nth"),
    ).select(
        key,
        CELL,
        "_latest_before",
        F.expr("last_set.kind AS _set_before"),
        F.expr("last_app AS _app_before"),
        F.when(F.col("_nth") > 1, F.struct(*end_state())).alias("_status_before"),
    )
    in_order = within(key, "_at")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    set_before = F.last(F.expr(f"CASE WHEN {UNGUARDED} THEN kind END"), ignorenulls=True).over(earlier)
    app = F.last(F.expr(f"CASE WHEN kind = '{S.REGISTER}' THEN struct(application_id) END"), ignorenulls=True).over(so_far)
    effective = f"""CASE kind WHEN '{S.LAUNCH_FAILED}' THEN _set IS NULL
        WHEN '{S.HEALTH_FAILED}' THEN _set <=> '{S.REGISTER}' ELSE true END"""
    status = f"""struct({state_after("kind")} AS state, CASE WHEN kind = '{S.REGISTER}' THEN address END AS address,
        _app.application_id AS application_id)"""
    return (
        carry(log, carried, key)
        .withColumns(
            {
                "_from": F.greatest("_latest_before", F.max("ts").over(so_far)),
                "_set": F.coalesce(set_before, F.col("_set_before")),
                "_app": F.coalesce(app, F.col("_app_before")),
            }
        )
        .where(effective)
        .withColumn("_status", F.expr(status))
        .withColumn("_previous", F.coalesce(F.lag("_status").over(in_order), F.col("_status_before")))
        .where("_previous IS NULL OR NOT _previous <=> _status")
        .withColumns({"_to": F.lead("_from").over(in_order), "_first": F.lag("_at").over(in_order).isNull()})
        .select(key, "seq", "_at", "_from", "_to", "_first", "_status")
    )


def _spans(changes: DataFrame) -> DataFrame:
    """Intervals from changes. Only the first and last change of a cell are looked at beyond their cell."""
    key = "session_key"
    inner = changes.where("NOT _first AND _to IS NOT NULL")
    border = changes.where("_first OR _to IS NULL")
    following = F.lead("_from").over(Window.partitionBy(key).orderBy("_at"))
    border = border.withColumn("_to", F.coalesce("_to", following))
    return inner.unionByName(border).select(key, "seq", F.col("_from").alias("valid_from"), F.col("_to").alias("valid_to"), "_status.*")


def session_history(
    events: DataFrame, created: DataFrame, width: int = SEQ_CELL, keep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Validity intervals [valid_from, valid_to) per session; events without effect are dropped.

    Replays the log in ``seq`` order, per cell of ``width`` arrival numbers. The order of arrival is the truth, so time never runs
    backwards: an event counts from its own time or that of an event that arrived before it, whichever is
    later. A cell starts from the folded state of the cells before it and ends at the first change in those after it. The log and the changes are
    read twice each; ``keep`` may hold the changes, such as by writing them (``plans.shared.stored``).
    """
    log = _log_of(events, created, width)
    changes = _changes(log, _summaries(log))
    return _spans(keep(changes) if keep else changes)


def extend_history(
    events: DataFrame, created: DataFrame, before: DataFrame, width: int = SEQ_CELL, keep: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Intervals that a new slice of the log adds to a history, and where its sessions stand after it.

    ``before`` has a row per session of earlier slices: its summary and its open interval. Events of the slice have higher ``seq`` than all before.
    The intervals contain the open ones of ``before`` whose session changes, with their end. The second frame has the form of ``before``, for the
    sessions of the slice; their open intervals are there and not among the intervals. ``keep`` holds the summaries of the slice too, as three steps read them.
    """
    key = "session_key"
    log = _log_of(events, created, width)
    summaries = _summaries(log)
    summaries = keep(summaries) if keep else summaries
    touched = summaries.select(key).distinct()
    earlier = before.join(touched, key, "left_semi")
    start = earlier.select(key, F.lit(-(1 << 63)).cast("long").alias(CELL), *_SUMMARY, "last_app_at")
    known = summaries.select(start.columns).unionByName(start)
    open_before = earlier.where("valid_from IS NOT NULL").select(
        key,
        "seq",
        F.lit(-(1 << 63)).cast("long").alias("_at"),
        F.col("valid_from").alias("_from"),
        F.lit(None).cast(before.schema["valid_from"].dataType).alias("_to"),
        F.lit(True).alias("_first"),
        F.struct("state", "address", "application_id").alias("_status"),
    )
    changes = _changes(log, known).unionByName(open_before)
    spans = _spans(keep(changes) if keep else changes)
    stand = _summed_up(known).join(spans.where("valid_to IS NULL").drop("valid_to"), key, "left")
    return spans.where("valid_to IS NOT NULL"), stand


def launch_timeouts(
    launches: DataFrame,
    callbacks: DataFrame,
    exits: DataFrame,
    timeout_s: int,
    observed_until,
    width: int = TIME_CELL,
) -> DataFrame:
    """Outcome per launch: registered, exited, timed_out or pending.

    ``launches(session_key, launch_id, ts)``, ``callbacks(session_key, ts)`` and non-zero
    ``exits(session_key, ts)``; whatever comes after ``observed_until`` isn't known yet, launches included. A launch fails
    at its first exit or its deadline, unless a callback came by then; a later callback revives it. Finds the
    next callback and exit with one linear pass per (session, cell of ``width`` microseconds), not by pairing.
    """
    key = "session_key"
    until = moment(observed_until, launches.schema["ts"].dataType)
    no_id = F.lit(None).cast(launches.schema["launch_id"].dataType).alias("launch_id")
    known = F.col("ts") <= until
    log = (
        launches.where(known).select(key, "launch_id", "ts", F.lit(0).alias("_what"))
        .unionByName(callbacks.where(known).select(key, no_id, "ts", F.lit(1).alias("_what")))
        .unionByName(exits.where(known).select(key, no_id, "ts", F.lit(2).alias("_what")))
        .withColumn("_at", micros(F.col("ts")))
        .withColumn(CELL, cell_of(F.col("_at"), width))
    )
    callback, exit_ts = F.expr("CASE WHEN _what = 1 THEN ts END"), F.expr("CASE WHEN _what = 2 THEN ts END")
    later = across(key, descending=True)
    carried = (
        log.groupBy(key, CELL)
        .agg(F.min(callback).alias("_c"), F.min(exit_ts).alias("_e"))
        .select(
            key,
            CELL,
            F.last("_c", ignorenulls=True).over(later).alias("_callback_later"),
            F.last("_e", ignorenulls=True).over(later).alias("_exit_later"),
        )
    )
    # Backwards in time, launches last among equals, so "last seen" is the next one at or after the launch.
    back = within(key, F.col("_at").desc(), F.col("_what").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    next_callback = F.coalesce(F.last(callback, ignorenulls=True).over(back), F.col("_callback_later"))
    next_exit = F.coalesce(F.last(exit_ts, ignorenulls=True).over(back), F.col("_exit_later"))
    rows = carry(log, carried, key)
    deadline = plus_seconds(F.col("ts"), timeout_s)
    outcome = (
        F.when(F.col("registered_at") <= F.coalesce(F.least("_exit", "_deadline"), "_deadline"), "registered")
        .when(F.col("_exit") <= F.col("_deadline"), "exited")
        .when(F.col("_deadline") <= until, "timed_out")
        .otherwise("pending")
    )
    failed_at = "CASE outcome WHEN 'exited' THEN _exit WHEN 'timed_out' THEN _deadline END AS failed_at"
    return (
        rows.withColumns({"registered_at": next_callback, "_exit": next_exit, "_deadline": deadline})
        .where("_what = 0")
        .withColumn("outcome", outcome)
        .selectExpr(
            key,
            "launch_id",
            "ts AS launched_at",
            "registered_at",
            failed_at,
            "outcome",
            "outcome IN ('exited', 'timed_out') AND registered_at IS NOT NULL AS revived",
        )
    )


def idle_sessions(activity: DataFrame, timeout_s: int, observed_until) -> DataFrame:
    """When each session's idle timer stops it, null if not by ``observed_until``.

    ``activity(session_key, start_ts, end_ts, control)``; rows with a control value aren't activity but
    can mark the session start t0. The timer looks every 60 s from t0 and stops the session at the
    first look with its last activity more than the timeout ago.

    Two activities less than a timeout apart never have a stop between them. So the log is first
    reduced, map-side, to one row per (session, timeout-wide cell of time), which bounds a session
    by the time it spans and not by its number of requests; the ordered walk runs on the cells.
    """
    key = "session_key"
    poll = S.IDLE_POLL_S * SECOND
    cell = max(timeout_s * SECOND, 1)
    counts = F.col("control").isNull()
    start, end = F.col("_start"), F.col("_end")
    cells = (
        activity.select(
            key, "start_ts", "control", micros(F.col("start_ts")).alias("_start"), micros(F.col("end_ts")).alias("_end")
        )
        .groupBy(key, floor_div(start, cell).alias("_cell"))
        .agg(
            F.min("start_ts").alias("_t0_ts"),
            F.min("_start").alias("_t0"),
            F.min(F.when(counts, start)).alias("_first"),
            F.max(F.when(counts, start)).alias("_last"),
            F.max(F.when(counts, end)).alias("_last_end"),
            F.count_if(counts).alias("_n"),
        )
    )
    in_order = Window.partitionBy(key).orderBy("_cell")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    t0 = F.col("t0")

    def stop_look(last_active):
        """Number of the first look more than the timeout after ``last_active``."""
        return floor_div(last_active + timeout_s * SECOND - t0, poll) + 1

    # A running query counts as active at each look it spans: the last look strictly before its end.
    last_look = t0 + (ceil_div(F.col("_last_end") - t0, poll) - 1) * poll
    walked = (
        cells.withColumn("t0", F.first("_t0").over(so_far))
        .withColumn("t0_ts", F.first("_t0_ts").over(so_far))
        .withColumn("_active", F.greatest(F.col("_last"), last_look))
        .withColumn("_look", stop_look(F.greatest(t0, F.max("_active").over(earlier))))
        .withColumn("_broken", F.col("_first") > t0 + F.col("_look") * poll)
        .withColumn("_after", F.max(F.coalesce("_broken", F.lit(False))).over(so_far))
        .groupBy(key)
        .agg(
            F.min("t0").alias("t0"),
            F.min("t0_ts").alias("started_at"),
            F.min(F.when(F.col("_broken"), F.col("_look"))).alias("_break"),
            F.max("_active").alias("_active"),
            F.sum("_n").alias("activities"),
            F.sum(F.when(F.col("_after"), F.col("_n")).otherwise(0)).alias("after_stop"),
        )
    )
    look = F.coalesce("_break", stop_look(F.greatest(t0, F.col("_active"))))
    stop = plus_seconds(F.col("started_at"), look * S.IDLE_POLL_S)
    until = moment(observed_until, activity.schema["start_ts"].dataType)
    return walked.select(
        key, "started_at", F.when(stop <= until, stop).alias("stopped_at"), "activities", "after_stop"
    )
