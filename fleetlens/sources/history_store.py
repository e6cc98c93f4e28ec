"""Session history kept up to date slice by slice of the log.

Where each session stands (its summary and open interval) is a bucketed table; what a slice closes is a folder of its own. A slice reads and rewrites
the buckets of its sessions and adds its folder. The table's manifest commits both: folders of later versions aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.lifecycle import extend_history
from fleetlens.plans.cells import SEQ_CELL
from fleetlens.plans.shared import scratch, stored
from fleetlens.sources.bucket_table import BucketTable

_STAND = """session_key bigint, last_set struct<kind: string, address: string, at: bigint>, last_health bigint, launch_failed boolean,
    last_app struct<application_id: string>, last_app_at bigint, latest {ts}, seq bigint, valid_from {ts}, state string, address string, application_id string"""
_CLOSED = "session_key bigint, seq bigint, valid_from {ts}, valid_to {ts}, state string, address string, application_id string, slice bigint"


class HistoryStore:
    """``ts`` is the type of the log's times: timestamp or timestamp_ntz."""

    def __init__(self, spark: SparkSession, path: str, ts: str = "timestamp", buckets: int = 64):
        self.spark, self.path, self.ts = spark, path, ts
        schema = T.StructType.fromDDL(_STAND.format(ts=ts))
        self.sessions = BucketTable(spark, f"{path}/sessions", schema, "session_key", buckets)

    def _closed(self) -> str:
        return f"{self.path}/closed"

    def add(self, events: DataFrame, created: DataFrame, width: int = SEQ_CELL) -> int:
        """Take up the next slice of the log; its events have higher ``seq`` than all before, its times may be late. Returns its number."""
        version = self.sessions.latest() + 1
        with scratch(self.spark):
            keys = events.select("session_key").unionByName(created.select("session_key"))
            buckets = [row[0] for row in keys.select(self.sessions.bucket_of(F.col("session_key"))).distinct().collect()]
            before = self.sessions.read(buckets, version - 1)
            spans, stand = extend_history(events, created, before, width, keep=lambda df: stored(df, "changes"))
            spans.write.mode("overwrite").parquet(f"{self._closed()}/slice={version}")
            self.sessions.update(stand, ["session_key"], version=version)
        self.sessions.vacuum()
        return version

    def read(self) -> DataFrame:
        """The history of all slices so far, as ``session_history`` has it."""
        version = self.sessions.latest()
        stand = self.sessions.read(version=version).where("valid_from IS NOT NULL")
        open_spans = stand.withColumn("valid_to", F.lit(None).cast(self.ts))
        columns = ["session_key", "seq", "valid_from", "valid_to", "state", "address", "application_id"]
        if not version:
            return open_spans.select(columns)
        closed = self.spark.read.schema(_CLOSED.format(ts=self.ts)).parquet(self._closed()).where(F.col("slice") <= version)
        return closed.select(columns).unionByName(open_spans.select(columns))
