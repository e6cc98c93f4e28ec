"""The launch timer as a log of changes that later slices correct.

A stream that has reported a timeout can't take it back. Here every slice of the log, such as a batch of a stream, adds rows to a log of changes:
a launch has failed, a late callback has revived it, or a callback that came late shows that it had not failed at all. The last change of a launch is
what ``launch_timeouts`` says of it.

Rows of the log and what was said of each launch are bucketed tables. A slice reads the buckets of its sessions and of launches that have come due, puts
their results anew with the batch operator, and writes what differs. Rows may come in any order and however late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.clock import plus_seconds
from fleetlens.operators.lifecycle import launch_timeouts
from fleetlens.plans.cells import TIME_CELL
from fleetlens.plans.shared import exists, scratch, stored
from fleetlens.sources.bucket_table import BucketTable

LAUNCH, CALLBACK, EXIT = "launch", "callback", "exit_nonzero"
_ROWS = "session_key bigint, row string, kind string, launch_id bigint, ts {ts}"
_RESULTS = "session_key bigint, launch_id bigint, launched_at {ts}, registered_at {ts}, failed_at {ts}, outcome string, revived boolean"
_PENDING = "session_key bigint, launch_id bigint, deadline {ts}"


class LaunchTimer:
    """``ts`` is the type of the log's times: timestamp or timestamp_ntz."""

    def __init__(self, spark: SparkSession, path: str, timeout_s: int, ts: str = "timestamp", buckets: int = 64):
        self.spark, self.path, self.timeout_s, self.ts = spark, path, timeout_s, ts

        def table(name: str, schema: str) -> BucketTable:
            return BucketTable(spark, f"{path}/{name}", T.StructType.fromDDL(schema.format(ts=ts)), "session_key", buckets)

        self.rows, self.pending, self.results = table("rows", _ROWS), table("pending", _PENDING), table("results", _RESULTS)

    def latest(self) -> int:
        """The newest slice that is complete: its results are committed last."""
        return self.results.latest()

    def _mark(self, version: int):
        """The latest time seen up to a slice."""
        folder = f"{self.path}/mark/{version}"
        return self.spark.read.schema(f"mark {self.ts}").parquet(folder).first().mark if version and exists(self.spark, folder) else None

    def take(self, log: DataFrame, version: int | None = None, width: int = TIME_CELL) -> int:
        """Take up a slice ``log(session_key, kind, launch_id, ts)`` of launches, callbacks and non-zero exits. Returns its number.

        With a ``version`` a slice that is tried again counts once.
        """
        version = self.latest() + 1 if version is None else version
        before = max((v for v in self.results.versions() if v < version), default=0)
        with scratch(self.spark):
            unique = F.concat(F.lit(f"{version}-"), F.monotonically_increasing_id().cast("string"))
            new = stored(log.select("session_key", unique.alias("row"), "kind", "launch_id", "ts"), "slice")
            marks = [m for m in (self._mark(before), new.agg(F.max("ts")).first()[0]) if m is not None]
            if not marks:
                return before
            mark = max(marks)
            due = self.pending.read(version=before).where(F.col("deadline") <= F.lit(mark)).select("session_key")
            sessions = stored(new.select("session_key").unionByName(due).distinct(), "sessions")
            buckets = [row[0] for row in sessions.select(self.rows.bucket_of(F.col("session_key"))).distinct().collect()]
            known = self.rows.read(buckets, before).unionByName(new).join(sessions, "session_key", "left_semi")
            now = stored(self._results(known, mark, width), "results")
            said = self.results.read(buckets, before).join(sessions, "session_key", "left_semi")
            self._changes(now, said, version).write.mode("overwrite").parquet(f"{self.path}/changes/slice={version}")
            self.spark.createDataFrame([(mark,)], f"mark {self.ts}").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/mark/{version}")
            self.rows.update(new, ["session_key", "row"], version=version)
            open_now = now.where("outcome = 'pending'").select("session_key", "launch_id", plus_seconds(F.col("launched_at"), self.timeout_s).alias("deadline"))
            settled = now.where("outcome <> 'pending'").select("session_key", "launch_id")
            self.pending.update(open_now, ["session_key", "launch_id"], gone=settled, version=version)
            self.results.update(now, ["session_key", "launch_id"], version=version)
        for table in (self.rows, self.pending, self.results):
            table.vacuum()
        return version

    def _results(self, known: DataFrame, mark, width: int) -> DataFrame:
        def kind(name: str) -> DataFrame:
            return known.where(F.col("kind") == name)

        return launch_timeouts(kind(LAUNCH), kind(CALLBACK), kind(EXIT), self.timeout_s, mark, width)

    def _changes(self, now: DataFrame, said: DataFrame, version: int) -> DataFrame:
        """What differs from what was said, with the kind of change."""
        fields = ["launched_at", "registered_at", "failed_at", "outcome", "revived"]
        both = now.join(said.select("session_key", "launch_id", F.struct(*fields).alias("_said")), ["session_key", "launch_id"], "left")
        failed = "outcome IN ('exited', 'timed_out')"
        change = F.expr(f"""CASE WHEN outcome = 'registered' THEN if(_said.{failed}, 'withdrawn', 'registered')
            WHEN revived AND NOT _said.revived <=> true THEN 'revived' ELSE 'failed' END""")
        differs = F.col("_said").isNull() | ~F.struct(*fields).eqNullSafe(F.col("_said"))
        return both.where(differs & (F.col("outcome") != "pending")).select("session_key", "launch_id", change.alias("change"), *fields)

    def changes(self) -> DataFrame:
        """All changes so far, with the slice that made them."""
        schema = f"session_key bigint, launch_id bigint, change string, {_RESULTS.format(ts=self.ts).split(', ', 2)[2]}, slice bigint"
        if not self.latest():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/changes").where(F.col("slice") <= self.latest())

    def net(self) -> DataFrame:
        """The last change of each launch, as ``launch_timeouts`` has the launches that aren't pending."""
        fields = ["launched_at", "registered_at", "failed_at", "outcome", "revived"]
        last = self.changes().groupBy("session_key", "launch_id").agg(F.max_by(F.struct(*fields), "slice").alias("_last"))
        return last.select("session_key", "launch_id", "_last.*")


def run_launch_timer(stream: DataFrame, timer: LaunchTimer) -> LaunchTimer:
    """Take up a streaming log batch by batch, to the end of its input. Called again with the same timer, it goes on where it was."""

    def take(rows: DataFrame, batch: int) -> None:
        timer.take(rows, version=batch + 1)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{timer.path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return timer
