"""The net of the timer's changes against the batch operator, for late and disordered slices."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from replay import T0
from support import rows

from fleetlens.operators.lifecycle import launch_timeouts
from fleetlens.sources.bucket_table import BucketTable
from fleetlens.sources.logs import stream_log
from fleetlens.streaming.launch_timer import LaunchTimer, run_launch_timer

LOG = "session_key long, kind string, launch_id long, ts timestamp"


def random_log(seed, n=500):
    """A third of the rows are of one session; a fifth arrive late, callbacks among them that tell of a launch that had not failed."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        at = i * 8 - (rng.randrange(1500) if rng.random() < 0.2 else 0)
        kind = rng.choice(["launch", "launch", "callback", "exit_nonzero"])
        made.append((0 if rng.random() < 0.34 else rng.randrange(25), kind, i if kind == "launch" else None, T0 + timedelta(seconds=at)))
    return made


def batch_of(spark, log, timeout_s=300):
    frame = spark.createDataFrame(log, LOG)
    until = max(r[3] for r in log)
    kind = lambda name: frame.where(F.col("kind") == name)
    return launch_timeouts(kind("launch"), kind("callback"), kind("exit_nonzero"), timeout_s, until).where("outcome <> 'pending'")


@pytest.mark.parametrize("cuts", [[120, 125], [80, 160, 240, 320, 400]])
def test_net_changes_equal_the_batch(spark, tmp_path, cuts):
    log = random_log(31)
    timer = LaunchTimer(spark, str(tmp_path / "t"), 300, buckets=4)
    edges = [0, *cuts, len(log)]
    for a, b in zip(edges, edges[1:]):
        timer.take(spark.createDataFrame(log[a:b], LOG))
    assert rows(timer.net()) == rows(batch_of(spark, log))
    kinds = {r.change for r in timer.changes().collect()}
    assert {"failed", "registered"} <= kinds
    if len(cuts) > 4:
        assert kinds == {"failed", "registered", "revived", "withdrawn"}


def test_a_timeout_that_is_withdrawn_and_one_that_is_revived(spark, tmp_path):
    timer = LaunchTimer(spark, str(tmp_path / "t"), 300, buckets=4)
    at = lambda s: T0 + timedelta(seconds=s)
    take = lambda *made: timer.take(spark.createDataFrame(list(made), LOG))
    take((1, "launch", 1, at(0)), (2, "launch", 2, at(10)))
    assert timer.changes().count() == 0
    take((9, "callback", None, at(1000)))
    assert sorted((r.launch_id, r.change, r.failed_at) for r in timer.changes().collect()) == [(1, "failed", at(300)), (2, "failed", at(310))]
    take((1, "callback", None, at(299)), (2, "callback", None, at(900)))
    told = {r.launch_id: (r.change, r.outcome, r.registered_at, r.revived) for r in timer.changes().where("slice = 3").collect()}
    assert told == {1: ("withdrawn", "registered", at(299), False), 2: ("revived", "timed_out", at(900), True)}


def test_a_stream_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    log, path = random_log(32, 300), str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(log[i * 100 : (i + 1) * 100], LOG).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: stream_log(spark, path, spark.createDataFrame([], LOG).schema, files_per_trigger=1)
    timer = LaunchTimer(spark, str(tmp_path / "t"), 300, buckets=4)
    update, calls = BucketTable.update, []

    def failing(table, *args, **kw):
        calls.append(1)
        if len(calls) == 5:
            raise RuntimeError("driver lost")
        return update(table, *args, **kw)

    monkeypatch.setattr(BucketTable, "update", failing)
    with pytest.raises(Exception, match="driver lost"):
        run_launch_timer(stream(), timer)
    run_launch_timer(stream(), timer)
    assert rows(timer.net()) == rows(batch_of(spark, log))


def test_nothing_yet(spark, tmp_path):
    timer = LaunchTimer(spark, str(tmp_path / "t"), 300, buckets=4)
    timer.take(spark.createDataFrame([], LOG))
    assert timer.net().count() == 0
