"""Reading the session registry: listing, lookup, and creating rows."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions.clock import moment
from fleetlens.functions.text import render_link
from fleetlens.plans.numbering import dense_number

_UTC_TIME = re.compile(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d{1,6})?([Zz]|[+-]\d\d:\d\d)")


def info_columns(ui_template: str | None = None, log_template: str | None = None) -> list[Column]:
    """What a caller sees of a session."""
    return [
        F.col("id"),
        F.col("name"),
        F.col("token"),
        F.col("state"),
        F.col("address").isNotNull().alias("active"),
        render_link(ui_template, F.col("application_id")).alias("ui_url"),
        render_link(log_template, F.col("application_id")).alias("log_url"),
    ]


def parse_states(states: str | None) -> list[str]:
    """The states named in a comma-separated filter. One unknown name rejects the filter."""
    wanted = [piece.strip() for piece in (states or "").split(",") if piece.strip()]
    unknown = [piece for piece in wanted if piece not in S.STATES]
    if unknown:
        raise ValueError(f"unknown state: {unknown[0]}")
    return wanted


def parse_timestamp(value: str | datetime | None) -> datetime | None:
    """A full date and time in UTC, as ``2024-05-01T12:00:00Z``; anything else is refused."""
    if value is None or isinstance(value, datetime):
        return value
    if not _UTC_TIME.fullmatch(value):
        raise ValueError(f"malformed timestamp: {value}")
    try:
        return datetime.fromisoformat(value.replace("z", "Z"))
    except ValueError as error:
        raise ValueError(f"malformed timestamp: {value}") from error


def list_sessions(
    registry: DataFrame,
    owner: str,
    state: str | None = None,
    created_after: str | datetime | None = None,
    created_before: str | datetime | None = None,
    ui_template: str | None = None,
    log_template: str | None = None,
) -> DataFrame:
    """The owner's sessions, by state and creation time; both time bounds are inclusive.

    All conditions are plain comparisons on stored columns, so they reach the scan. Bad arguments
    raise ``ValueError`` before any job starts.
    """
    wanted = parse_states(state)
    after, before = parse_timestamp(created_after), parse_timestamp(created_before)
    created_type = registry.schema["created_at"].dataType
    rows = registry.where(F.col("username") == owner)
    if wanted:
        rows = rows.where(F.col("state").isin(wanted))
    if after is not None:
        rows = rows.where(F.col("created_at") >= moment(after, created_type))
    if before is not None:
        rows = rows.where(F.col("created_at") <= moment(before, created_type))
    return rows.select(*info_columns(ui_template, log_template))


def lookup_sessions(
    registry: DataFrame, keys: DataFrame, ui_template: str | None = None, log_template: str | None = None
) -> DataFrame:
    """One row per requested (username, id). Another owner's session counts as not found.

    A key asked for many times is answered once, and is one row before it is shuffled.
    """
    info = registry.select("username", "id", F.lit(True).alias("found"), *info_columns(ui_template, log_template)[1:])
    wanted = keys.select("username", "id").distinct()
    return wanted.join(info, ["username", "id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def register_sessions(
    launches: DataFrame,
    next_id: int,
    order: Column,
    tie: Column,
    created_at: Column | None = None,
    token: Column | None = None,
    width: int | None = None,
) -> DataFrame:
    """New registry rows for ``launches(username, name)``, in state LAUNCHING.

    Ids run on from ``next_id`` in (order, tie) order. Random tokens and the current time are the
    defaults; they change with every evaluation, so write the result once before using it twice.
    """
    numbered = dense_number(launches, order, tie, "_number", width)
    return numbered.select(
        (F.lit(next_id) + F.col("_number")).cast("long").alias("id"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        "username",
        "name",
        F.lit(S.LAUNCHING).alias("state"),
        (F.expr("uuid()") if token is None else token).alias("token"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("string").alias("application_id"),
    )
