"""Time arithmetic. Pin ``spark.sql.session.timeZone`` to UTC when the inputs are TIMESTAMP_NTZ."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000


def moment(value: str | datetime, ts_type: T.DataType) -> Column:
    """A literal of the given timestamp type. A value without offset is UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    value = value.astimezone(UTC) if value.tzinfo else value.replace(tzinfo=UTC)
    if isinstance(ts_type, T.TimestampNTZType):
        value = value.replace(tzinfo=None)
    return F.lit(value.isoformat(sep=" ")).cast(ts_type)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp_ltz"))


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    """``ts`` moved by whole seconds, keeping its timestamp type."""
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def floor_div(value: Column, divisor: int) -> Column:
    """Integer floor division, exact for any long."""
    by = F.lit(divisor)
    return F.call_function("div", value - F.pmod(value, by), by)


def ceil_div(value: Column, divisor: int) -> Column:
    return -floor_div(-value, divisor)
