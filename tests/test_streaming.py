"""Streams against their batch forms, with a far-future row in a second file that closes everything."""

from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from support import SF, rows

from fleetlens.catalog.fixtures import view, with_zone
from fleetlens.operators import lifecycle
from fleetlens.operators.resolution import one_session_per_token
from fleetlens.sources.bucket_table import BucketTable
from fleetlens.sources.logs import stream_log
from fleetlens.streaming import operators as streaming
from fleetlens.streaming.run import append_to_files, upsert_to_files

TIMEOUT_S = 21_600
SENTINEL = -1


def staged(spark, folder, df, sentinel):
    """``df`` in one file, a row far in the future in a second, as a stream that reads one at a time."""
    path = str(folder)
    df.coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([sentinel], df.schema).coalesce(1).write.mode("append").parquet(path)
    return stream_log(spark, path, df.schema, files_per_trigger=1)


def test_registry_stream_equals_fold_in_any_order(spark, tmp_path):
    log = with_zone(view(spark, SF, "fx_lifecycle"))
    path = str(tmp_path / "log")
    for part in (2, 0, 1):
        log.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    stream = stream_log(spark, path, log.schema, files_per_trigger=1)
    got = upsert_to_files(streaming.stream_registry(stream), "session_key", "t")
    assert rows(got) == rows(lifecycle.fold_lifecycle(log))


@pytest.mark.parametrize("timeout_s", [TIMEOUT_S, 1800])
def test_launch_timeout_stream_equals_batch(spark, tmp_path, timeout_s):
    log = with_zone(view(spark, SF, "fx_launch_events"))
    far = log.agg(F.max("ts")).first()[0] + timedelta(days=30)
    launches = log.where("kind = 'launch'").select("session_key", F.col("event_id").alias("launch_id"), "ts")
    signals = log.where("kind <> 'launch'").select("session_key", "ts")
    late = streaming.stream_launch_timeouts(
        staged(spark, tmp_path / "l", launches, (SENTINEL, 0, far)),
        staged(spark, tmp_path / "s", signals, (SENTINEL, far)),
        timeout_s,
        "1 hour",
    )
    got = append_to_files(late, "t")[0].where(F.col("session_key") != SENTINEL)
    batch = lifecycle.launch_timeouts(
        launches, log.where("kind = 'callback'"), log.where("kind = 'exit_nonzero'"), timeout_s, far
    )
    want = batch.where("outcome = 'timed_out'").select("session_key", "launch_id", "launched_at", "failed_at")
    assert rows(got) == rows(want)
    assert got.count() > 50


def test_idle_stream_equals_gap_rule(spark, tmp_path):
    log = with_zone(view(spark, SF, "fx_activity"))
    far = log.agg(F.max("end_ts")).first()[0] + timedelta(days=30)
    stream = staged(spark, tmp_path / "a", log, (SENTINEL, far, far, None))
    got, _ = append_to_files(streaming.stream_idle_sessions(stream, TIMEOUT_S, "1 hour"), "t")
    spans = {}
    for key, start, end in sorted((r.session_key, r.start_ts, r.end_ts) for r in log.where("control IS NULL").collect()):
        until = max(start, end) + timedelta(seconds=TIMEOUT_S)
        mine = spans.setdefault(key, [])
        if mine and start <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], until)
            mine[-1][2] += 1
        else:
            mine.append([start, until, 1])
    want = sorted((k, *span) for k, found in spans.items() for span in found)
    assert sorted(tuple(r) for r in got.where(F.col("session_key") != SENTINEL).collect()) == want


def test_idle_stream_stops_at_most_one_look_early(spark, tmp_path):
    log = with_zone(view(spark, SF, "fx_activity")).where("control IS NULL")
    far = log.agg(F.max("end_ts")).first()[0] + timedelta(days=30)
    stream = staged(spark, tmp_path / "a", log, (SENTINEL, far, far, None))
    spans, _ = append_to_files(streaming.stream_idle_sessions(stream, TIMEOUT_S, "1 hour"), "t")
    first = spans.groupBy("session_key").agg(F.min("idle_at").alias("idle_at"))
    exact = lifecycle.idle_sessions(log, TIMEOUT_S, far)
    early = first.join(exact, "session_key").select(
        (F.unix_micros("stopped_at") - F.unix_micros("idle_at")).alias("d")
    )
    gaps = [r.d for r in early.collect()]
    close = [g for g in gaps if -60_000_000 <= g <= 60_000_000]
    assert len(close) >= 0.9 * len(gaps)


def parts(spark, folder, df, column, share):
    """``df`` in files of growing ``column``: the first ``share`` of them now, the rest by calling what is returned."""
    path, n = str(folder), 6
    tiles = F.ntile(n).over(Window.orderBy(column))
    cut = df.withColumn("_tile", tiles)

    def put(first, last):
        for tile in range(first, last):
            cut.where(F.col("_tile") == tile + 1).drop("_tile").coalesce(1).write.mode("append").parquet(path)

    put(0, share)
    return path, lambda: put(share, n)


def started_twice(spark, tmp_path, sources, build, run):
    """Rows of a query that ran over a part of its input, was built anew and went on, and of one that ran once."""
    made = [parts(spark, tmp_path / f"in{i}", df, column, 3) for i, (df, column) in enumerate(sources)]
    streams = lambda: [stream_log(spark, path, df.schema, files_per_trigger=1) for (path, _), (df, _) in zip(made, sources)]
    folder = str(tmp_path / "state")
    run(build(*streams()), folder)
    for _, rest in made:
        rest()
    twice = run(build(*streams()), folder)
    once = run(build(*streams()), str(tmp_path / "once"))
    return rows(twice), rows(once)


def appended(stream, folder):
    return append_to_files(stream, "t", folder)[0]


def test_registry_stream_goes_on_after_a_restart(spark, tmp_path):
    log = with_zone(view(spark, SF, "fx_lifecycle"))
    run = lambda stream, folder: upsert_to_files(stream, "session_key", "t", folder)
    twice, once = started_twice(spark, tmp_path, [(log, "seq")], streaming.stream_registry, run)
    assert twice == once == rows(lifecycle.fold_lifecycle(log))


def test_registry_stream_survives_a_crash_before_its_commit(spark, tmp_path, monkeypatch):
    """The driver is lost after a batch was written and before the stream has noted it."""
    log = with_zone(view(spark, SF, "fx_lifecycle"))
    path, rest = parts(spark, tmp_path / "in", log, "seq", 6)
    build = lambda: streaming.stream_registry(stream_log(spark, path, log.schema, files_per_trigger=1))
    folder, seen = str(tmp_path / "state"), []
    update = BucketTable.update

    def failing(table, *args, **kw):
        done = update(table, *args, **kw)
        seen.append(done)
        if len(seen) == 3:
            raise RuntimeError("driver lost")
        return done

    monkeypatch.setattr(BucketTable, "update", failing)
    with pytest.raises(Exception, match="driver lost"):
        upsert_to_files(build(), "session_key", "t", folder)
    got = upsert_to_files(build(), "session_key", "t", folder)
    assert seen.count(seen[2]) == 2
    assert rows(got) == rows(lifecycle.fold_lifecycle(log))


def test_registry_stream_forgets_old_terminal_sessions(spark, tmp_path):
    log = with_zone(view(spark, SF, "fx_lifecycle"))
    now = log.agg(F.max("ts")).first()[0]
    path, rest = parts(spark, tmp_path / "in", log, "seq", 3)
    build = lambda: streaming.stream_registry(stream_log(spark, path, log.schema, files_per_trigger=1), last_event=True)
    expired = streaming.is_expired(now.replace(tzinfo=None), 86_400)
    folder = str(tmp_path / "state")
    upsert_to_files(build(), "session_key", "t", folder, expired)
    rest()
    got = upsert_to_files(build(), "session_key", "t", folder, expired)
    want = lifecycle.fold_lifecycle(log, last_event=True)
    assert rows(got) == rows(want.where(~expired))
    assert 0 < got.count() < want.count()


def test_launch_timeout_stream_goes_on_after_a_restart(spark, tmp_path):
    log = with_zone(view(spark, SF, "fx_launch_events"))
    launches = log.where("kind = 'launch'").select("session_key", F.col("event_id").alias("launch_id"), "ts")
    signals = log.where("kind <> 'launch'").select("session_key", "ts")
    build = lambda a, b: streaming.stream_launch_timeouts(a, b, TIMEOUT_S, "1 hour")
    twice, once = started_twice(spark, tmp_path, [(launches, "ts"), (signals, "ts")], build, appended)
    assert twice == once and len(once) > 20


def test_idle_stream_goes_on_after_a_restart(spark, tmp_path):
    log = with_zone(view(spark, SF, "fx_activity"))
    build = lambda a: streaming.stream_idle_sessions(a, TIMEOUT_S, "1 hour")
    twice, once = started_twice(spark, tmp_path, [(log, "start_ts")], build, appended)
    assert twice == once and len(once) > 20


def test_resolution_stream_goes_on_after_a_restart(spark, tmp_path):
    requests = with_zone(view(spark, SF, "fx_requests"))
    sessions = one_session_per_token(view(spark, SF, "fx_registry"))
    build = lambda r: streaming.stream_request_resolution(r, sessions)
    twice, once = started_twice(spark, tmp_path, [(requests, "ts")], build, appended)
    assert twice == once and len(once) == requests.count()


def test_the_watermark_is_kept(spark, tmp_path):
    log = with_zone(view(spark, SF, "fx_activity"))
    path, _ = parts(spark, tmp_path / "in", log, "start_ts", 6)
    build = lambda: streaming.stream_idle_sessions(stream_log(spark, path, log.schema), TIMEOUT_S, "1 hour")
    _, first = append_to_files(build(), "t", str(tmp_path / "s"))
    _, again = append_to_files(build(), "t", str(tmp_path / "s"))
    assert first == again and first.year == 2024
