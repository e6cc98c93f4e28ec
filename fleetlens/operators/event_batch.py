"""A batch of events of all kinds, in order, on a registry that exists.

``events(seq, kind, token, id, username, address, application_id)``: callbacks and connect failures name a session by its token, stops
by id and owner, launch and health failures by id. ``seq`` is the order of arrival and unique. A failed spawn is a launch_failed here: its
row was made a moment before. Rules and guards are those of single updates (``transitions``).

``apply_events`` gives the new registry. Only launch_failed and health_failed look at the old state, so what a run of events does to a row follows from
a few facts that aggregate in any order, and from the state the row has: the facts of the three kinds of key are reduced on their own, combined map-side,
and meet on the registry row, which is read once and never multiplied.

``event_effects`` says of each event what it found and did, which needs the order: one pass per (session, cell), as for the history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions.lifecycle import UNGUARDED, fold_facts, state_after
from fleetlens.plans.cells import CELL, SEQ_CELL, across, carry, cell_of, within

_TOKEN_KINDS = (S.REGISTER, S.UNREGISTER, S.CONNECT_FAILED)
_GUARDED_KINDS = (S.LAUNCH_FAILED, S.HEALTH_FAILED)


@dataclass(frozen=True)
class AppliedEvents:
    """``marked`` is the new registry with marks: ``_hit``, whether an event set the row, and by kind how many events did or, for
    health_failed, how many reached it."""

    marked: DataFrame

    @property
    def registry(self) -> DataFrame:
        return self.marked.select(*S.REGISTRY_COLUMNS)

    @property
    def touched(self) -> DataFrame:
        return self.marked.where("_hit").select(*S.REGISTRY_COLUMNS)


def _count(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind).alias(f"_{kind}")


def apply_events(registry: DataFrame, events: DataFrame) -> AppliedEvents:
    """The registry after all events, as if they had been applied one by one in ``seq`` order.

    Events that name no row change nothing. Rows that share a token are all set by its events.
    """
    by_token = events.where(F.col("kind").isin(*_TOKEN_KINDS)).groupBy("token").agg(
        F.max_by(F.struct("seq", "kind", "address"), "seq").alias("_set"),
        F.min("seq").alias("_first_set"),
        F.max_by(F.struct("application_id"), F.when(F.col("kind") == S.REGISTER, F.col("seq"))).alias("_app"),
        *map(_count, _TOKEN_KINDS),
    )
    by_owner = events.where(F.col("kind") == S.STOP).groupBy("id", "username").agg(
        F.max("seq").alias("_last_stop"), F.min("seq").alias("_first_stop"), _count(S.STOP)
    )
    failed, unhealthy = (F.when(F.col("kind") == kind, F.col("seq")) for kind in _GUARDED_KINDS)
    by_id = events.where(F.col("kind").isin(*_GUARDED_KINDS)).groupBy("id").agg(
        F.min(failed).alias("_first_failed"), F.max(unhealthy).alias("_last_health"), _count(S.HEALTH_FAILED)
    )
    rows = registry.join(by_token, "token", "left").join(by_owner, ["id", "username"], "left").join(by_id, "id", "left")
    stopped_last = F.col("_last_stop").isNotNull() & (F.col("_set").isNull() | (F.col("_last_stop") > F.col("_set.seq")))
    facts = {
        "_kind": F.when(stopped_last, S.STOP).otherwise(F.col("_set.kind")),
        "_at": F.greatest("_set.seq", "_last_stop"),
        "_first": F.least("_first_set", "_first_stop"),
    }
    alone = f"""CASE WHEN state = '{S.LAUNCHING}' AND _first_failed IS NOT NULL THEN '{S.FAILED}'
        WHEN state = '{S.RUNNING}' AND _last_health IS NOT NULL THEN '{S.FAILED}' ELSE state END"""
    ends_running = f"_kind = '{S.REGISTER}' AND NOT coalesce(_last_health > _at, false)"
    after = {
        "_launch_failed": F.expr(f"cast(state = '{S.LAUNCHING}' AND _first_failed IS NOT NULL AND NOT coalesce(_first < _first_failed, false) AS bigint)"),
        "_state": F.expr(f"""CASE WHEN _kind IS NULL THEN {alone} WHEN _kind = '{S.REGISTER}' AND NOT ({ends_running}) THEN '{S.FAILED}'
            ELSE {state_after("_kind")} END"""),
        "_address": F.expr(f"""CASE WHEN _kind IS NULL THEN if(state = '{S.RUNNING}' AND _last_health IS NOT NULL, null, address)
            WHEN {ends_running} THEN _set.address END"""),
        "_hit": F.expr(f"""_kind IS NOT NULL OR coalesce(state = '{S.LAUNCHING}' AND _first_failed IS NOT NULL
            OR state = '{S.RUNNING}' AND _last_health IS NOT NULL, false)"""),
    }
    app = F.when(F.col("_app").isNotNull(), F.col("_app.application_id")).otherwise(F.col("application_id"))
    counts = [F.coalesce(f"_{kind}", F.lit(0).cast("long")).alias(f"_{kind}") for kind in (*_TOKEN_KINDS, S.STOP, *_GUARDED_KINDS)]
    marked = rows.withColumns(facts).withColumns(after).select(
        "id",
        "created_at",
        "username",
        "name",
        F.col("_state").alias("state"),
        "token",
        F.col("_address").alias("address"),
        app.alias("application_id"),
        "_hit",
        *counts,
    )
    return AppliedEvents(marked)


def _key_of_event() -> Column:
    by_id = F.col("id").cast("string")
    return (
        F.when(F.col("kind").isin(*_TOKEN_KINDS), F.concat(F.lit("t"), "token"))
        .when(F.col("kind") == S.STOP, F.concat(F.lit("o"), by_id, F.lit(" "), "username"))
        .when(F.col("kind").isin(*_GUARDED_KINDS), F.concat(F.lit("i"), by_id))
    )


def event_effects(registry: DataFrame, events: DataFrame, width: int = SEQ_CELL) -> DataFrame:
    """One row per event and registry row it names: seq, kind, id, token, matched, effective, state, address, application_id, signal_address.

    ``effective`` tells whether the event set the row; state, address and application_id are those after it. ``signal_address`` is where a stop found the
    session, which gets a stop message there. An event that names no row has one row without an id. Events of a kind that isn't known match nothing.
    """
    by_id = F.col("id").cast("string")
    keys = F.array(F.concat(F.lit("t"), "token"), F.concat(F.lit("i"), by_id), F.concat(F.lit("o"), by_id, F.lit(" "), "username"))
    sessions = registry.select(
        F.explode(keys).alias("_key"),
        "id",
        "token",
        F.col("state").alias("_state0"),
        F.col("address").alias("_address0"),
        F.col("application_id").alias("_app0"),
    )
    asked = events.select("seq", "kind", "address", "application_id", _key_of_event().alias("_key"))
    known = asked.join(sessions, "_key", "left").withColumn("_at", F.col("seq"))
    log = known.withColumn(CELL, F.when(F.col("id").isNull(), F.xxhash64("seq")).otherwise(cell_of(F.col("_at"), width)))
    before = across("id")
    carried = (
        log.where("id IS NOT NULL")
        .groupBy("id", CELL)
        .agg(*fold_facts("_at"))
        .select(
            "id",
            CELL,
            F.last("last_set", ignorenulls=True).over(before).alias("_set_carried"),
            F.max("last_health").over(before).alias("_health_carried"),
            F.max("launch_failed").over(before).alias("_failed_carried"),
            F.last("last_app", ignorenulls=True).over(before).alias("_app_carried"),
        )
    )
    earlier = within("id", "_at").rowsBetween(Window.unboundedPreceding, -1)

    def seen(kind: str, value: str = "_at") -> Column:
        return F.expr(f"CASE WHEN kind = '{kind}' THEN {value} END")

    set_by = F.last(F.expr(f"CASE WHEN {UNGUARDED} THEN struct(kind, address, _at AS at) END"), ignorenulls=True).over(earlier)
    app_by = F.last(seen(S.REGISTER, "struct(application_id)"), ignorenulls=True).over(earlier)
    found = {
        "_set": F.coalesce(set_by, "_set_carried"),
        "_health": F.greatest(F.max(seen(S.HEALTH_FAILED)).over(earlier), "_health_carried"),
        "_failed": F.coalesce(F.max(F.col("kind") == S.LAUNCH_FAILED).over(earlier), F.lit(False)) | F.coalesce("_failed_carried", F.lit(False)),
        "_app": F.coalesce(app_by, "_app_carried", F.struct(F.col("_app0").alias("application_id"))),
    }
    unwell = "coalesce(_health > _set.at, false)"
    status = {
        "_state": F.expr(f"""CASE WHEN id IS NULL THEN null WHEN _set IS NULL THEN CASE WHEN _state0 = '{S.LAUNCHING}' AND _failed THEN '{S.FAILED}'
                WHEN _state0 = '{S.RUNNING}' AND _health IS NOT NULL THEN '{S.FAILED}' ELSE _state0 END
            WHEN _set.kind = '{S.REGISTER}' AND {unwell} THEN '{S.FAILED}' ELSE {state_after("_set.kind")} END"""),
        "_address": F.expr(f"""CASE WHEN _set IS NULL THEN if(_state0 = '{S.RUNNING}' AND _health IS NOT NULL, null, _address0)
            WHEN _set.kind = '{S.REGISTER}' AND NOT {unwell} THEN _set.address END"""),
    }
    effective = F.expr(f"""CASE WHEN id IS NULL THEN false WHEN kind = '{S.LAUNCH_FAILED}' THEN coalesce(_state = '{S.LAUNCHING}', false)
        WHEN kind = '{S.HEALTH_FAILED}' THEN coalesce(_state = '{S.RUNNING}', false) ELSE true END""")
    clears = F.expr(f"kind <> '{S.LAUNCH_FAILED}'")
    return (
        carry(log, carried, "id")
        .withColumns(found)
        .withColumns(status)
        .withColumn("effective", effective)
        .select(
            "seq",
            "kind",
            "id",
            "token",
            F.col("id").isNotNull().alias("matched"),
            "effective",
            F.when(F.col("effective"), F.expr(state_after("kind"))).otherwise(F.col("_state")).alias("state"),
            F.when(F.col("effective") & clears, seen(S.REGISTER, "address")).otherwise(F.col("_address")).alias("address"),
            F.when(F.col("effective") & (F.col("kind") == S.REGISTER), F.col("application_id")).otherwise(F.col("_app.application_id")).alias("application_id"),
            F.when(F.col("kind") == S.STOP, F.col("_address")).alias("signal_address"),
        )
    )


def effect_counts(effects: DataFrame) -> DataFrame:
    """Per kind: events, how many of them named a row, and rows they set, as the service reports them."""
    named = F.count_distinct(F.when(F.col("matched"), F.col("seq")))
    return effects.groupBy("kind").agg(
        F.count_distinct("seq").alias("events"), named.alias("matched"), F.count_if("effective").alias("rows")
    )
