"""Applying batches of events to the registry, copy-on-write.

Every event batch is first reduced to one row per key with partial aggregation, so the join never
multiplies registry rows and a key with many events is small before it is shuffled. Results come
in a ``Change``: the new registry and the side outputs, each one lazy.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions.clock import moment


@dataclass(frozen=True)
class Change:
    """``marked`` is the new registry with a flag ``_hit`` on the rows that were set."""

    marked: DataFrame
    unmatched: DataFrame | None = None
    to_signal: DataFrame | None = None

    @property
    def registry(self) -> DataFrame:
        return self.marked.drop("_hit")

    @property
    def touched(self) -> DataFrame:
        return self.marked.where("_hit").drop("_hit")


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _change(
    registry: DataFrame,
    hits: DataFrame,
    keys: list[str],
    state: str,
    address: Column,
    application_id: Column | None = None,
    guard: Column | None = None,
) -> DataFrame:
    """Set ``state``, ``address`` and ``application_id`` on the rows that ``hits`` (unique by key) names."""
    hit = F.col("_hit").isNotNull()
    if guard is not None:
        hit = hit & guard
    app = F.col("application_id") if application_id is None else application_id
    joined = registry.join(hits.withColumn("_hit", F.lit(True)), keys, "left").withColumn(
        "_hit", F.coalesce(hit, F.lit(False))
    )
    return joined.select(
        "id",
        "created_at",
        "username",
        "name",
        F.when(F.col("_hit"), state).otherwise(F.col("state")).alias("state"),
        "token",
        F.when(F.col("_hit"), address).otherwise(F.col("address")).alias("address"),
        F.when(F.col("_hit"), app).otherwise(F.col("application_id")).alias("application_id"),
        "_hit",
    )


def apply_registrations(registry: DataFrame, events: DataFrame) -> Change:
    """``events(seq, token, address, application_id)`` set RUNNING, whatever the state was.

    The last event per token wins. Tokens without a row are returned as ``unmatched``.
    """
    last = (
        events.groupBy("token")
        .agg(F.max_by(F.struct("address", "application_id"), "seq").alias("_e"))
        .select("token", F.col("_e.address").alias("_address"), F.col("_e.application_id").alias("_application_id"))
    )
    after = _change(
        registry, last, ["token"], S.RUNNING, F.col("_address"), F.col("_application_id")
    )
    return Change(after, unmatched=last.select("token").join(registry, "token", "left_anti"))


def apply_unregistrations(registry: DataFrame, events: DataFrame) -> Change:
    """``events(token)`` set FINISHED and clear the address, whatever the state was."""
    tokens = events.select("token").distinct()
    after = _change(registry, tokens, ["token"], S.FINISHED, _no_text())
    return Change(after, unmatched=tokens.join(registry, "token", "left_anti"))


def apply_stops(registry: DataFrame, stops: DataFrame) -> Change:
    """``stops(username, id)`` set FINISHED and clear the address if the owner matches.

    ``to_signal`` holds the address and token of stopped sessions that had an address before.
    """
    keys = ["username", "id"]
    wanted = stops.select(*keys).distinct()
    after = _change(registry, wanted, keys, S.FINISHED, _no_text())
    return Change(
        after,
        unmatched=wanted.join(registry, keys, "left_anti"),
        to_signal=registry.where(F.col("address").isNotNull())
        .join(wanted, keys, "left_semi")
        .select("id", "address", "token"),
    )


def apply_launch_failures(registry: DataFrame, failures: DataFrame, guarded: bool = True) -> Change:
    """``failures(id)`` set FAILED, only from LAUNCHING. A failed spawn isn't ``guarded``.

    Address and application id stay as they are.
    """
    ids = failures.select("id").distinct()
    guard = (F.col("state") == S.LAUNCHING) if guarded else None
    after = _change(registry, ids, ["id"], S.FAILED, F.col("address"), guard=guard)
    return Change(after, unmatched=ids.join(registry, "id", "left_anti"))


def apply_connect_failures(registry: DataFrame, attempts: DataFrame) -> Change:
    """``attempts(token, attempt, ok)``: FAILED once all four attempts were made and none succeeded."""
    bits = F.bit_or(F.when(~F.col("ok"), F.call_function("shiftleft", F.lit(1), F.col("attempt"))))
    all_failed = sum(1 << n for n in range(1, S.MAX_ATTEMPTS + 1))
    given_up = (
        attempts.where(F.col("attempt").between(1, S.MAX_ATTEMPTS))
        .groupBy("token")
        .agg(F.bool_or("ok").alias("_ok"), bits.alias("_failed"))
        .where(~F.col("_ok") & (F.col("_failed") == all_failed))
        .select("token")
    )
    after = _change(registry, given_up, ["token"], S.FAILED, _no_text())
    return Change(after, unmatched=given_up.join(registry, "token", "left_anti"))


def health_sweep(registry: DataFrame, probes: DataFrame) -> Change:
    """``probes(id, attempt, ok)``: RUNNING rows without an address or a success among attempts 1..4 fail."""
    healthy = (
        probes.where(F.col("attempt").between(1, S.MAX_ATTEMPTS) & F.col("ok"))
        .select("id")
        .distinct()
        .withColumn("_healthy", F.lit(True))
    )
    joined = registry.join(healthy, "id", "left").withColumn(
        "_hit",
        F.col("state").eqNullSafe(S.RUNNING) & (F.col("address").isNull() | F.col("_healthy").isNull()),
    )
    swept = joined.select(
        "id",
        "created_at",
        "username",
        "name",
        F.when(F.col("_hit"), S.FAILED).otherwise(F.col("state")).alias("state"),
        "token",
        F.when(~F.col("_hit"), F.col("address")).alias("address"),
        "application_id",
        "_hit",
    )
    return Change(swept)


def prune_cutoff(now: datetime, age_s: int) -> datetime:
    """Whole seconds of ``now`` minus the age; the age counts from creation."""
    if age_s < 0:
        raise ValueError("age must not be negative")
    return now.replace(microsecond=0) - timedelta(seconds=age_s)


def is_prunable(registry: DataFrame, cutoff: datetime) -> Column:
    """FAILED or FINISHED, and created at or before the cutoff. Never null: rows without a state or time stay."""
    at = moment(cutoff, registry.schema["created_at"].dataType)
    return F.coalesce(F.col("state").isin(*S.TERMINAL_STATES) & (F.col("created_at") <= at), F.lit(False))


@dataclass(frozen=True)
class Pruned:
    kept: DataFrame
    pruned: DataFrame


def prune_terminal(registry: DataFrame, now: datetime, age_s: int) -> Pruned:
    """Split off FAILED and FINISHED rows created at or before the cutoff. Others stay at any age."""
    old = is_prunable(registry, prune_cutoff(now, age_s))
    return Pruned(kept=registry.where(~old), pruned=registry.where(old))


def count_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row count that is taken while it is written, not by a second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
