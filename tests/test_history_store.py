"""A history kept slice by slice against the history of the whole log."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from replay import T0, random_log
from support import rows

from fleetlens.operators.lifecycle import session_history
from fleetlens.sources.bucket_table import BucketTable
from fleetlens.sources.history_store import HistoryStore

LOG = "seq long, ts timestamp_ntz, session_key long, kind string, address string, application_id string"
MADE = "session_key long, created_at timestamp_ntz"


def late_log(seed, sessions=40, events=900):
    """Times jump back and forth and are often equal."""
    rng = random.Random(seed)
    return [(seq, T0 + timedelta(seconds=rng.randrange(80)), *rest) for seq, _, *rest in random_log(seed, sessions, events, hot_share=0.34)]


def frames(spark, log, created):
    return spark.createDataFrame(log, LOG), spark.createDataFrame(created, MADE)


@pytest.mark.parametrize("cuts, width", [([300, 310], 50), ([1, 450], 1 << 16), ([100, 200, 300], 7)])
def test_slices_equal_the_whole(spark, tmp_path, cuts, width):
    log = late_log(21)
    created = [(k, T0 + timedelta(seconds=k % 9)) for k in range(42)]
    first = {}
    for seq, _, key, *_ in log:
        first.setdefault(key, seq)
    store = HistoryStore(spark, str(tmp_path / "h"), "timestamp_ntz", buckets=8)
    edges = [0, *cuts, len(log)]
    for a, b in zip(edges, edges[1:]):
        store.add(*frames(spark, log[a:b], [(k, at) for k, at in created if a <= first.get(k, 0) < b]), width)
    assert rows(store.read()) == rows(session_history(*frames(spark, log, created), width))


def test_only_the_buckets_of_a_slice_are_read(spark, tmp_path, monkeypatch):
    log, created = late_log(22), [(k, T0) for k in range(40)]
    store = HistoryStore(spark, str(tmp_path / "h"), "timestamp_ntz", buckets=16)
    store.add(*frames(spark, log, created))
    opened, read = [], BucketTable.read

    def noted(table, buckets=None, version=None):
        found = read(table, buckets, version)
        opened.append(found.inputFiles())
        return found

    monkeypatch.setattr(BucketTable, "read", noted)
    before = store.sessions._folders(1)
    store.add(*frames(spark, [(5000, T0 + timedelta(seconds=200), 7, "stop", None, None)], []))
    after = store.sessions._folders(2)
    assert len({path.split("_bucket=")[1].split("/")[0] for files in opened for path in files}) == 1
    assert sum(before[b] != after[b] for b in before) == 1
    whole = log + [(5000, T0 + timedelta(seconds=200), 7, "stop", None, None)]
    assert rows(store.read()) == rows(session_history(*frames(spark, whole, created)))


def test_a_slice_that_failed_is_taken_up_again(spark, tmp_path):
    log, created = late_log(23), [(k, T0) for k in range(40)]
    store = HistoryStore(spark, str(tmp_path / "h"), "timestamp_ntz", buckets=4)
    store.add(*frames(spark, log[:500], created))
    before = rows(store.read())
    broken, none = frames(spark, log[500:], [])
    with pytest.raises(Exception, match="no disk"):
        store.add(broken.withColumn("address", F.when(F.col("seq") == 880, F.raise_error(F.lit("no disk"))).otherwise(F.col("address"))), none)
    assert rows(store.read()) == before
    store.add(broken, none)
    assert rows(store.read()) == rows(session_history(*frames(spark, log, created)))


def test_nothing_yet_and_empty_slices(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), "timestamp_ntz", buckets=4)
    assert store.read().count() == 0
    store.add(*frames(spark, [], []))
    assert store.read().count() == 0
    store.add(*frames(spark, [], [(1, T0)]))
    store.add(*frames(spark, [], []))
    assert [(r.session_key, r.state, r.valid_to) for r in store.read().collect()] == [(1, "LAUNCHING", None)]
