"""Where a job may put files that must survive the loss of an executor, and how it gets rid of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, which has to be set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """A path in the file system it belongs to, as Spark itself reaches it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what is directly in a folder, none if it isn't there."""
    files, place = _at(spark, path)
    return sorted(found.getPath().getName() for found in files.listStatus(place)) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)


_held: list[list[str]] = [[]]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is ``stored`` inside is removed at the end, so write the result of a job before."""
    _held.append([])
    try:
        yield
    finally:
        for path in _held.pop():
            remove(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, for a costly result that is used twice.

    It stays until the ``scratch`` around it ends, or for good outside of one.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    _held[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
