"""Ordered logs in cells, so that no task needs all rows of a key.

A window partitioned by key sends a whole key to one task, which AQE can't split. So every ordered pass here runs per
(key, cell), where a cell is a fixed width of the order: of time or of arrival numbers. What a cell needs from
its neighbours comes from one summary row per (key, cell), made with map-side sums, and a window over these few rows. The summaries
are joined back on (key, cell), the same keys the pass itself is dealt by. The plan is the same for every size.

A lookup of one row per key is a plain join, whose hot keys AQE splits. Streams have no AQE, so there it may be dealt by (key, salt), the
side with one row per key being repeated for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.clock import SECOND, floor_div

CELL = "_cell"
#: Widths of a cell: arrival numbers, and microseconds. Five minutes: an hour with a third of all rows is a dozen cells.
SEQ_CELL = 1 << 16
TIME_CELL = 300 * SECOND


def cell_of(order: Column, width: int) -> Column:
    return floor_div(order, width)


def within(key: str, *order: str | Column):
    """Rows of a cell in order."""
    return Window.partitionBy(key, CELL).orderBy(*order)


def across(key: str, descending: bool = False):
    """The cells of a key in order, without the current one."""
    order = F.col(CELL).desc() if descending else F.col(CELL)
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def carry(rows: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``summaries`` (one row per key and cell)."""
    return rows.join(summaries, [key, CELL], "left")


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, row_id: str, salts: int = 1) -> DataFrame:
    """Left join of ``lookup``, unique by ``key``, that spreads the rows of a key over ``salts`` tasks, and those without one over all.

    One salt is a plain join: a lookup table bucketed by its key isn't shuffled, and AQE splits hot keys.
    """
    if salts == 1:
        return rows.join(lookup, key, "left")
    spread = F.xxhash64(row_id)
    salted = rows.withColumn("_salt", F.when(F.col(key).isNull(), spread).otherwise(F.pmod(spread, F.lit(salts))))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")
