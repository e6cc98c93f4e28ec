"""Bucketed storage: lookups read their buckets only, and a failed write changes nothing."""

import glob
import os
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from support import rows

from fleetlens import schemas as S
from fleetlens.operators.event_batch import apply_events
from fleetlens.plans.shared import exists, names_in, scratch, stored
from fleetlens.sources.bucket_table import BucketTable
from fleetlens.sources.registry_store import RegistryStore

NOW = datetime(2024, 5, 1)


def sessions(n=300):
    made = []
    for i in range(n):
        owner = "busy" if i % 3 == 0 else f"u{i % 40}"
        state = S.STATES[i % 4]
        made.append((i, NOW - timedelta(hours=i), owner, None, state, f"t{i}", f"h{i}:1" if state == S.RUNNING else None, None))
    return made


@pytest.fixture
def store(spark, tmp_path):
    made = RegistryStore(spark, str(tmp_path / "registry"), buckets=16)
    made.replace(spark.createDataFrame(sessions(), S.REGISTRY_SCHEMA))
    return made


def buckets_read(df):
    return {path.split("_bucket=")[1].split("/")[0] for path in df.inputFiles()}


def test_owner_lookup_reads_one_bucket(store):
    found = store.of_owner("u7")
    assert len(buckets_read(found)) == 1
    assert sorted(r.id for r in found.collect()) == [r[0] for r in sessions() if r[2] == "u7"]
    assert store.of_owner("nobody").count() == 0


def test_token_lookup_reads_the_buckets_of_its_owners(store):
    found = store.of_tokens(["t5", "t10", "unknown"])
    assert len(buckets_read(found)) <= 2
    assert sorted(r.id for r in found.collect()) == [5, 10]
    assert store.of_tokens(["unknown"]).count() == 0


def test_files_are_sorted_and_have_small_bloom_filters(spark, store, tmp_path):
    paths = glob.glob(f"{store.sessions.path}/data/*/*/*.parquet")
    for path in paths:
        names = pq.read_table(path, columns=["username"]).column(0).to_pylist()
        assert names == sorted(names)
    plain = str(tmp_path / "plain")
    store.read().coalesce(1).write.parquet(plain)
    one = sum(Path(p).stat().st_size for p in glob.glob(f"{plain}/*.parquet"))
    sizes = [Path(p).stat().st_size for p in paths]
    assert max(sizes) > one
    assert sum(sizes) < len(sizes) * 200_000


def test_an_update_rewrites_its_buckets_only(spark, store):
    before = store.sessions._folders(1)
    events = spark.createDataFrame(
        [(1, "register", "t4", None, None, "new:1", "a"), (2, "unregister", "t7", None, None, None, None)],
        "seq long, kind string, token string, id long, username string, address string, application_id string",
    )
    applied = apply_events(store.of_tokens(["t4", "t7"]), events)
    store.update(applied.touched)
    after = store.sessions._folders(2)
    assert sum(before[b] != after[b] for b in before) in (1, 2)
    got = {r.id: (r.state, r.address) for r in store.read().collect()}
    assert got[4] == ("RUNNING", "new:1") and got[7] == ("FINISHED", None)
    assert len(got) == 300


def test_add_and_prune(spark, store):
    store.add(spark.createDataFrame([(1000, NOW, "newcomer", None, S.LAUNCHING, "t1000", None, None)], S.REGISTRY_SCHEMA))
    assert [r.id for r in store.of_tokens(["t1000"]).collect()] == [1000]
    store.prune(NOW, 100 * 3600)
    gone = {r[0] for r in sessions() if r[4] in S.TERMINAL_STATES and r[1] <= NOW - timedelta(hours=100)}
    assert {r.id for r in store.read().collect()} == set(range(300)) - gone | {1000}
    assert {r.id for r in store.tokens.read().collect()} == set(range(300)) - gone | {1000}


def test_a_failed_write_leaves_the_old_version(spark, store):
    broken = spark.createDataFrame(sessions(20), S.REGISTRY_SCHEMA).withColumn("name", F.raise_error(F.lit("disk full")).cast("string"))
    before = rows(store.read())
    with pytest.raises(Exception, match="disk full"):
        store.update(broken)
    assert store.sessions.versions() == [1]
    assert rows(store.read()) == before
    store.update(spark.createDataFrame(sessions(20), S.REGISTRY_SCHEMA))
    assert rows(store.read()) == before


def test_a_manifest_that_was_not_finished_is_not_read(spark, store):
    folder = f"{store.sessions.path}/manifest/2"
    spark.createDataFrame([(0, "nowhere")], "bucket int, folder string").write.parquet(folder)
    os.remove(f"{folder}/_SUCCESS")
    assert store.read().count() == 300
    store.update(spark.createDataFrame(sessions(20), S.REGISTRY_SCHEMA))
    assert store.sessions.versions() == [1, 2]
    assert store.read().count() == 300


def test_a_version_tried_again_counts_once(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k long, n long").schema, "k", 4)
    table.update(spark.createDataFrame([(i, 1) for i in range(10)], "k long, n long"), ["k"], version=2)
    for _ in range(3):
        old = table.read(version=2).where("k < 3").withColumn("n", F.col("n") + 1)
        table.update(old, ["k"], version=4)
    assert {r.k: r.n for r in table.read().collect()} == {k: 2 if k < 3 else 1 for k in range(10)}
    table.vacuum(keep=1)
    assert table.versions() == [4]
    assert len(names_in(spark, f"{table.path}/data")) == len(set(table._folders(4).values()))
    assert table.read().count() == 10


def test_scratch_is_removed(spark):
    with scratch(spark):
        kept = stored(spark.range(5), "t")
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert exists(spark, path) and kept.count() == 5
    assert not exists(spark, path)
