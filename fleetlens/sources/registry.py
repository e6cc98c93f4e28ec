"""The session registry as files or as a database table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas as S
from fleetlens.operators.resolution import one_session_per_token


def read_registry(
    spark: SparkSession, path: str, ntz: bool = False, day_from: date | None = None, day_to: date | None = None
) -> DataFrame:
    """A registry snapshot. The schema is given, so old snapshots without ``name`` read it as null.

    ``day_from`` and ``day_to`` (inclusive) leave out the folders of other creation days.
    """
    schema = S.REGISTRY_SCHEMA
    if ntz:
        kind = T.TimestampNTZType()
        schema = T.StructType(
            [T.StructField(f.name, kind if f.name == "created_at" else f.dataType, f.nullable) for f in schema]
        )
    rows = spark.read.schema(schema).parquet(path)
    if day_from is not None:
        rows = rows.where(F.col("created_day") >= F.lit(day_from))
    if day_to is not None:
        rows = rows.where(F.col("created_day") <= F.lit(day_to))
    return rows.select(*S.REGISTRY_COLUMNS)


def read_registry_jdbc(
    spark: SparkSession, url: str, id_range: tuple[int, int], partitions: int, table: str = "application", **options: str
) -> DataFrame:
    """The live table, read in id ranges by parallel queries; filters on it are sent to the database."""
    low, high = id_range
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="id", **options)
        .options(lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
        .load()
        .select(*[F.col(f.name).cast(f.dataType) for f in S.REGISTRY_SCHEMA])
    )


def write_registry(registry: DataFrame, path: str, writers_per_day: int = 64) -> None:
    """Write a new snapshot; refuses an existing folder, so a reader never sees a half-written one.

    Files are grouped by creation day, the column that listing and retention filter on. Rows of a
    day are spread over writers by token, as one day may hold most of the table.
    """
    (
        registry.select(*S.REGISTRY_COLUMNS, F.to_date("created_at").alias("created_day"))
        .repartition("created_day", F.pmod(F.xxhash64("token"), F.lit(writers_per_day)))
        .sortWithinPartitions("created_day", "username", "id")
        .write.mode("errorifexists")
        .partitionBy("created_day")
        .parquet(path)
    )


def write_token_lookup(registry: DataFrame, table: str, buckets: int) -> None:
    """One row per token as a table bucketed by token.

    Resolving requests against it, above all in each batch of a stream, doesn't shuffle the registry.
    """
    (
        one_session_per_token(registry)
        .repartition(buckets, "token")
        .write.mode("errorifexists")
        .bucketBy(buckets, "token")
        .sortBy("token")
        .saveAsTable(table)
    )


def check_states(registry: DataFrame) -> DataFrame:
    """Rows whose state is outside the domain."""
    return registry.where(F.col("state").isNull() | ~F.col("state").isin(*S.STATES))
