"""Dense row numbers over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.clock import micros
from fleetlens.plans.cells import CELL, SEQ_CELL, TIME_CELL, cell_of

_CELLS = 4096


def dense_number(rows: DataFrame, order: Column, tie: Column, out: str, width: int | None = None) -> DataFrame:
    """Add ``out`` = 1.. in (order, tie) order.

    The table is cut into cells of ``width`` of the order, a number or a time (by default 65,536, or five minutes). Cells are counted
    map-side, numbered from their offsets, and sorted on their own. Offsets are summed in runs of 4,096 cells and
    then over the runs, so the one task that sees all runs gets a row for each.
    """
    keyed = rows.withColumn("_o", order).withColumn("_t", tie)
    timed = keyed.schema["_o"].dataType.typeName().startswith("timestamp")
    at = micros(F.col("_o")) if timed else F.floor("_o").cast("long")
    keyed = keyed.withColumn(CELL, cell_of(at, width or (TIME_CELL if timed else SEQ_CELL)))
    counts = keyed.groupBy(CELL).agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", cell_of(F.col(CELL), _CELLS))
    inside = Window.partitionBy("_run").orderBy(F.col(CELL).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("_run").agg(F.sum("_n").alias("_all"))
    before = Window.orderBy(F.col("_run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_run").alias("_r"), F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    offsets = counts.join(runs, F.col("_run").eqNullSafe(F.col("_r"))).select(
        F.col(CELL).alias("_c"), (F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_before")
    )
    number = F.row_number().over(Window.partitionBy(CELL).orderBy(F.col("_o").asc_nulls_first(), "_t"))
    joined = keyed.join(offsets, F.col(CELL).eqNullSafe(F.col("_c")))
    return joined.withColumn(out, F.col("_before") + number).select(*rows.columns, out)
