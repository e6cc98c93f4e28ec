"""Append-only logs, in batch and as streams, with their schemas given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_log(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None, only: str | None = None
) -> DataFrame:
    """A folder of Parquet files as a stream; ``only`` is a file name pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if only is not None:
        reader = reader.option("pathGlobFilter", only)
    return reader.parquet(folder)
