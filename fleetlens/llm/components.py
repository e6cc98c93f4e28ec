"""Connected components of an edge list in Spark, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.shared import stored


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges`` (u, v) to (u, v): every vertex of an edge with the smallest vertex of its component.

    Each round hooks the neighbours of a vertex to its smallest one, first those above it (large star), then those
    below (small star), until nothing changes. An edge becomes one edge, so rows never multiply, and sums of
    minima combine map-side. The edges of each round are written to the shared folder; only a
    count comes to the driver.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), label)
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.withColumnRenamed("m", "v"))
        now = stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
    return now.unionByName(now.select(F.col("v").alias("u"), "v")).distinct()
