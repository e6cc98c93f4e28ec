import uuid
from datetime import date, datetime, timedelta

import pytest
from support import rows

from fleetlens import jobs
from fleetlens import schemas as S
from fleetlens.operators.resolution import resolve_against_snapshot
from fleetlens.sources.callbacks import parse_callbacks
from fleetlens.sources.registry import check_states, read_registry, write_registry, write_token_lookup


def test_round_trip_and_old_snapshots(spark, tmp_path):
    made = [
        (i, datetime(2024, 1, 1 + i % 3), "u", f"n{i}" if i % 2 else None, S.RUNNING, f"t{i}", None, None) for i in range(50)
    ]
    table = spark.createDataFrame(made, S.REGISTRY_SCHEMA)
    path = str(tmp_path / "registry")
    write_registry(table, path)
    assert rows(read_registry(spark, path)) == rows(table)
    days = read_registry(spark, path, day_from=date(2024, 1, 2), day_to=date(2024, 1, 2))
    assert {r.created_at.day for r in days.collect()} == {2}
    assert "PartitionFilters: [isnotnull(created_day" in days._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="(?i)exist"):
        write_registry(table, path)
    old = str(tmp_path / "old")
    table.drop("name").write.parquet(old)
    back = read_registry(spark, old)
    assert back.columns == S.REGISTRY_COLUMNS
    assert back.where("name IS NOT NULL").count() == 0


def test_maintenance_jobs(spark, tmp_path, capsys):
    now = datetime(2024, 5, 1)
    made = [
        (1, now - timedelta(seconds=120), "u", None, S.FAILED, "a", None, None),
        (2, now - timedelta(seconds=10), "u", None, S.FAILED, "b", None, None),
        (3, now - timedelta(seconds=120), "u", None, S.RUNNING, "c", "h:1", None),
        (4, now - timedelta(seconds=120), "u", None, S.RUNNING, "d", "h:2", None),
    ]
    first, second, third = (str(tmp_path / n) for n in ("first", "second", "third"))
    write_registry(spark.createDataFrame(made, S.REGISTRY_SCHEMA), first)
    jobs.main(["prune", "--registry", first, "--out", second, "--seconds", "60", "--now", "2024-05-01T00:00:00"])
    probes = str(tmp_path / "probes")
    spark.createDataFrame([(3, 1, True), (4, 1, False)], S.PROBE_SCHEMA).write.parquet(probes)
    jobs.main(["check", "--registry", second, "--out", third, "--probes", probes])
    assert capsys.readouterr().out.split() == ["pruned", "1", "failed", "1"]
    left = {r.id: (r.state, r.address) for r in read_registry(spark, third).collect()}
    assert left == {2: (S.FAILED, None), 3: (S.RUNNING, "h:1"), 4: (S.FAILED, None)}


def test_unknown_states_are_reported(spark):
    table = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), "u", None, s, "t", None, None) for s in ("RUNNING", "running")], S.REGISTRY_SCHEMA
    )
    assert [r.state for r in check_states(table).collect()] == ["running"]


def test_callbacks_need_both_fields(spark):
    bodies = [
        '{"address": "h:1", "application_id": "a"}',
        '{"address": "h:1"}',
        '{"address": "h:1", "application_id": null}',
        "not json",
        '{"address": "", "application_id": "", "more": 1}',
        '{"address": "h:1", "application_id": 7}',
        '{"address": {"a": 1}, "application_id": "a"}',
        "[]",
        None,
    ]
    frame = spark.createDataFrame(list(enumerate(bodies)), "seq int, body string")
    parsed = {r.seq: (r.accepted, r.address) for r in parse_callbacks(frame, "body").collect()}
    assert parsed == {
        0: (True, "h:1"),
        1: (False, "h:1"),
        2: (False, "h:1"),
        3: (False, None),
        4: (True, ""),
        5: (False, "h:1"),
        6: (False, None),
        7: (False, None),
        8: (False, None),
    }


def test_bucketed_lookup_saves_the_shuffle_of_the_registry(spark):
    sessions = spark.range(1000).selectExpr("id", "concat('t', id % 900) AS token", "'RUNNING' AS state", "'h:1' AS address")
    table = f"lookup_{uuid.uuid4().hex}"
    write_token_lookup(sessions, table, buckets=4)
    try:
        calls = spark.range(2000).selectExpr(
            "id AS req_id", "'/x' AS path", "concat('Bearer t', id % 1000) AS auth_header", "concat('t', id % 1000) AS conn_token"
        )
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        resolved = resolve_against_snapshot(calls, spark.table(table), salts=1)
        assert resolved._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        got = {r.outcome: r["count"] for r in resolved.groupBy("outcome").count().collect()}
        assert got == {"ok": 1800, "not_found": 200}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {table}")
