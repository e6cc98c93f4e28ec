"""Running a streaming query over what is there, into files under the shared folder.

With a folder of the caller's, a query that was stopped or whose driver was lost goes on where it was: the same call with the same folder reads
its state, its progress and what it has written. Without one each call starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession

from fleetlens.plans.shared import exists, new_folder, scratch
from fleetlens.sources.bucket_table import BucketTable

BUCKETS = 16


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str | None) -> Iterator[None]:
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def append_to_files(stream: DataFrame, label: str, folder: str | None = None, keyed_state: bool = False) -> tuple[DataFrame, datetime]:
    """Run an append-mode query to the end of its input; its output, and the watermark up to which it has reported.

    ``keyed_state`` is for queries with a state of their own, which need the RocksDB state store. The watermark is kept beside the output. After a crash it may be that of an earlier run, so earlier than what the output has.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, label)
    with _setting(spark, _PROVIDER, _ROCKSDB if keyed_state else None):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start(f"{folder}/rows")
        )
        query.awaitTermination()
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    mark = max([_kept_mark(spark, folder), *map(datetime.fromisoformat, marks)])
    spark.createDataFrame([(mark.isoformat(),)], "mark string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/watermark")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), mark


def _kept_mark(spark: SparkSession, folder: str) -> datetime:
    if not exists(spark, f"{folder}/watermark/_SUCCESS"):
        return datetime.fromtimestamp(0, UTC)
    return datetime.fromisoformat(spark.read.schema("mark string").parquet(f"{folder}/watermark").first().mark)


def result_table(stream: DataFrame, key: str, folder: str, buckets: int = BUCKETS) -> BucketTable:
    """Where ``upsert_to_files`` keeps the latest row per key."""
    return BucketTable(stream.sparkSession, f"{folder}/table", stream.schema, key, buckets)


def upsert_to_files(
    stream: DataFrame, key: str, label: str, folder: str | None = None, expired: Column | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Run an update-mode query to the end of its input and read the latest row per key.

    A batch rewrites the buckets of its keys and commits them as a version of its own number, so one that is tried again starts from what the batch before
    it has left. Rows that meet ``expired`` are removed when the input is used up; if their key comes again, they come back.
    """
    spark = stream.sparkSession
    table = result_table(stream, key, folder or new_folder(spark, label), buckets)

    def write(rows: DataFrame, batch: int) -> None:
        with scratch(spark):
            table.update(rows, [key], version=2 * batch + 2)
        table.vacuum()

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{table.path}-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if expired is not None and table.latest() % 2 == 0:  # versions of batches are even
        with scratch(spark):
            table.delete(expired, [key], version=table.latest() + 1)
    return table.read()
