"""The streaming idle timer against the batch rule, to the look."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from replay import T0
from support import SF, rows

from fleetlens.catalog.fixtures import view, with_zone
from fleetlens.operators.lifecycle import idle_sessions
from fleetlens.sources.logs import stream_log
from fleetlens.streaming.idle_timer import open_idle_stops, stream_idle_stops
from fleetlens.streaming.run import append_to_files

ACTIVITY = "session_key long, start_ts timestamp, end_ts timestamp, control string"


def want_of(activity, timeout_s, until):
    exact = idle_sessions(activity, timeout_s, until)
    return exact.select("session_key", "started_at", "stopped_at", (F.col("activities") - F.col("after_stop")).alias("activities"))


def random_activity(seed, sessions=50):
    """Running queries, equal times, control rows alone, one hot session, and gaps about as long as the timeout."""
    rng = random.Random(seed)
    made = []
    for _ in range(1500):
        key = 0 if rng.random() < 0.34 else rng.randrange(sessions)
        start = T0 + timedelta(seconds=rng.randrange(40) * rng.choice([1, 60, 301, 3600]), microseconds=rng.choice([0, 0, 1, 999_999]))
        length = rng.choice([0, 0, 1, 59, 60, 61, rng.randrange(4000)])
        made.append((key, start, start + timedelta(seconds=length), rng.choice([None, None, None, "health"])))
    return made


def in_files(spark, path, made, parts=6):
    """The rows in order of time, in files that a stream reads one at a time."""
    made = sorted(made, key=lambda r: r[1])
    for i in range(parts):
        part = made[i * len(made) // parts : (i + 1) * len(made) // parts]
        spark.createDataFrame(part, ACTIVITY).coalesce(1).write.mode("append").parquet(path)
    return stream_log(spark, path, spark.createDataFrame([], ACTIVITY).schema, files_per_trigger=1)


@pytest.mark.parametrize("timeout_s", [61, 300, 3600])
def test_stops_are_those_of_the_batch_rule(spark, tmp_path, timeout_s):
    made = random_activity(timeout_s)
    far = T0 + timedelta(days=30)
    stream = in_files(spark, str(tmp_path / "in"), [*made, (-1, far, far, None)], parts=5)
    got, _ = append_to_files(stream_idle_stops(stream, timeout_s, "10 minutes"), "t", str(tmp_path / "s"), keyed_state=True)
    want = want_of(spark.createDataFrame(made, ACTIVITY), timeout_s, far)
    assert rows(got.where("session_key >= 0")) == rows(want)
    assert got.count() > 30


def test_open_sessions_and_a_restart(spark, tmp_path):
    log = with_zone(view(spark, SF, "fx_activity"))
    until = log.agg(F.max("end_ts")).first()[0].replace(tzinfo=None) + timedelta(days=2)
    made = [tuple(r) for r in log.select("session_key", "start_ts", "end_ts", "control").collect()]
    path, folder = str(tmp_path / "in"), str(tmp_path / "s")
    made.sort(key=lambda r: r[1])
    in_files(spark, path, made[: len(made) // 2], 3)
    build = lambda: stream_idle_stops(stream_log(spark, path, spark.createDataFrame([], ACTIVITY).schema, files_per_trigger=1), 21_600, "1 hour")
    append_to_files(build(), "t", folder, keyed_state=True)
    in_files(spark, path, made[len(made) // 2 :], 3)
    got, _ = append_to_files(build(), "t", folder, keyed_state=True)
    rest = open_idle_stops(got, log, 21_600, until)
    assert rows(got.unionByName(rest)) == rows(want_of(log, 21_600, until))
    assert got.count() > 10


def test_times_are_those_of_the_session_time_zone(spark, tmp_path):
    """Instants come out as they went in, wherever the session is."""
    made, far = random_activity(5), T0 + timedelta(days=30)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        stream = in_files(spark, str(tmp_path / "in"), [*made, (-1, far, far, None)], parts=2)
        got, _ = append_to_files(stream_idle_stops(stream, 300, "10 minutes"), "t", str(tmp_path / "s"), keyed_state=True)
        want = want_of(spark.createDataFrame(made, ACTIVITY), 300, "2024-03-01T00:00:00+00:00")
        assert rows(got.where("session_key >= 0")) == rows(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
