"""As-of lookup: for each row on the left, the latest row of its key on the right.

One shuffle of both sides and one linear pass per (key, cell); never the pairs of a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.cells import CELL, TIME_CELL, across, carry, cell_of, within


def asof_lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_order: Column,
    right_order: Column,
    right_tie: Column,
    row_id: str,
    width: int = TIME_CELL,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``left`` plus a struct column ``found``: the last ``right`` row with right_order <= left_order.

    Left rows with a null key are kept with a null ``found``, each in a cell of its own. A cell that has no right row
    of its own starts from the newest one of the cells before it. Both sides together are read twice; ``keep`` may hold them.
    """
    at = left.select(
        key,
        left_order.alias("_o"),
        F.lit(1).alias("_side"),
        F.expr("cast(null AS bigint) AS _tie"),
        F.struct(*left.columns).alias("_l"),
        F.lit(None).cast(right.schema).alias("_r"),
        F.when(F.col(key).isNull(), F.xxhash64(row_id)).otherwise(cell_of(left_order, width)).alias(CELL),
    )
    facts = right.select(
        key,
        right_order.alias("_o"),
        F.lit(0).alias("_side"),
        right_tie.alias("_tie"),
        F.lit(None).cast(left.schema).alias("_l"),
        F.struct(*right.columns).alias("_r"),
        cell_of(right_order, width).alias(CELL),
    )
    merged = at.unionByName(facts)
    if keep:
        merged = keep(merged)
    newest = merged.where(F.col(key).isNotNull()).groupBy(key, CELL).agg(
        F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_o", "_tie"))).alias("_newest")
    )
    carried = newest.select(key, CELL, F.last("_newest", ignorenulls=True).over(across(key)).alias("_carried"))
    upto = within(key, "_o", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.coalesce(F.last("_r", ignorenulls=True).over(upto), F.col("_carried"))
    return carry(merged, carried, key).withColumn("found", latest).where("_side = 1").select("_l.*", "found")
