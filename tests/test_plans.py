"""The shapes that must hold at scale."""

import random

import pytest
from support import SF
from pyspark.sql import functions as F

from fleetlens.catalog.fixtures import view
from fleetlens.catalog.queries import QUERIES, SERVICE
from fleetlens.functions.clock import micros
from fleetlens.operators import launch, lifecycle
from fleetlens.operators.registry import list_sessions
from fleetlens.plans.asof import asof_lookup
from fleetlens.plans.cells import TIME_CELL, cell_of
from fleetlens.plans.numbering import dense_number
from fleetlens.plans.shared import stored

BATCH = [name for name in QUERIES if not name.startswith("stream_")]
#: Queries that write an intermediate result, or a table, before the plan they return.
WRITING = {
    "session_history",
    "incremental_session_history",
    "launch_timer_net",
    "registry_store_lookup",
    "registry_store_update",
    "resolve_requests",
    "request_outcomes",
    "resolve_cached_requests",
    "resolve_with_connects",
    "request_outcomes_with_connects",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pairing_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text
    # One task for the version catalogue's default, and for one row per 4,096 cells of new sessions.
    assert "SinglePartition" not in text or name in (
        "resolve_versions",
        "launch_specs",
        "effective_config",
        "register_sessions",
    )


def test_list_pushes_its_filters(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "registry")
    view(spark, SF, "fx_registry").write.parquet(path)
    shown = list_sessions(spark.read.parquet(path), "user-5", state="RUNNING", created_after="1996-01-01T00:00:00Z")
    text = plan(shown)
    for pushed in ("EqualTo(username,user-5)", "EqualTo(state,RUNNING)", "GreaterThanOrEqual(created_at"):
        assert pushed in text
    assert "Exchange" not in text


def test_fold_combines_before_its_one_shuffle(spark):
    text = plan(lifecycle.fold_lifecycle(view(spark, SF, "fx_lifecycle")))
    assert text.count("Exchange") == 1
    assert "partial_max_by" in text
    assert "Window" not in text


@pytest.mark.parametrize("name", [name for name in BATCH if name not in WRITING])
def test_building_a_query_starts_no_job(spark, name):
    """Counted by Spark's job group; schemas are read before."""
    QUERIES[name](spark, SF)
    spark.sparkContext.setJobGroup("building", name)
    QUERIES[name](spark, SF)
    started = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(started) == 0


def test_ordered_passes_run_per_cell(spark):
    log = view(spark, SF, "fx_lifecycle")
    made = log.select("session_key", F.col("ts").alias("created_at"))
    text = plan(lifecycle.session_history(log, made))
    assert "partial_max" in text and "hashpartitioning(session_key#" in text
    for node in (line for line in text.splitlines() if "Window [" in line and "_status" in line):
        assert "_cell" in node


@pytest.mark.parametrize("name", ["resolve_requests", "request_outcomes"])
def test_resolution_reads_and_shuffles_little(spark, name):
    """What the plan scans is stored: the requests with the facts they are looked up in, for the summaries and for the pass."""
    text = plan(QUERIES[name](spark, SF))
    assert text.count("FileScan") <= 3
    assert text.count("Exchange hashpartitioning") <= 5


def test_history_looks_beyond_a_cell_at_its_border_only(spark):
    log = view(spark, SF, "fx_lifecycle")
    made = log.groupBy("session_key").agg(F.min("ts").alias("created_at"))
    text = plan(lifecycle.session_history(log, made, keep=lambda df: stored(df, "changes")))
    assert text.count("FileScan") <= 2
    assert text.count("Exchange hashpartitioning") == 1


def test_a_lookup_side_is_not_repeated(spark):
    for name in ("resolve_against_snapshot", "upstream_reuse"):
        assert "Generate explode" not in plan(QUERIES[name](spark, SF))


def test_idle_windows_run_on_cells(spark):
    text = plan(lifecycle.idle_sessions(view(spark, SF, "fx_activity"), 3600, "2024-02-15"))
    assert "partial_count" in text or "partial_sum" in text
    assert text.index("Window") < text.rindex("partial_min")


@pytest.mark.parametrize("operator", [launch.effective_config, launch.launch_specs])
def test_settings_are_shuffled_once(spark, operator):
    """One shuffle of the launches and one of the user's settings; the others are of the configuration tables."""
    launches = spark.range(9000).selectExpr("id AS session_id", "'u' AS username", "'4.0.0' AS version_name", "'n' AS app_name", "'t' AS token", "true AS packaged")
    asked = spark.range(9000).selectExpr("id AS session_id", "'k' AS conf_key", "'v' AS conf_value")
    tables = [view(spark, SF, name) for name in ("fx_conf_layers", "fx_versions")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        text = plan(operator(launches, asked, *tables, SERVICE))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(session_id#") + text.count("Exchange hashpartitioning(id#") == 2
    assert "FullOuter" not in text and ("Window" in text) == (operator is launch.effective_config)


def test_a_version_s_settings_go_through_no_sort(spark):
    """A map of all that a version gives, on every row of every session, was most of what a task had to sort."""
    tables = [view(spark, SF, name) for name in ("fx_launches", "fx_user_conf", "fx_conf_layers", "fx_versions")]
    found = launch.effective_config(tables[0].withColumn("packaged", F.lit(True)), *tables[1:], SERVICE)
    nodes, windows = [found._jdf.queryExecution().optimizedPlan()], 0
    while nodes:
        node = nodes.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window":
            windows += 1
            assert "map<" not in children[0].schema().simpleString()
        nodes += children
    assert windows


def test_a_hot_hour_of_one_session_is_several_cells(spark):
    """A third of all rows in one hour of one session: no (session, cell) has a tenth of them, for sessions, and no cell has it over all."""
    hot = spark.range(40_000).selectExpr("7L AS session_key", "id", "timestamp_micros(1700000000000000 + id * 90000) AS ts")
    rest = spark.range(80_000).selectExpr("id % 500 + 100 AS session_key", "id", "timestamp_micros(1700000000000000 + id * 20000000) AS ts")
    rows = hot.unionByName(rest).withColumn("cell", cell_of(micros(F.col("ts")), TIME_CELL))
    for keys in (["session_key", "cell"], ["cell"]):
        largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
        assert largest <= rows.count() / 10


def tied_rows(spark):
    """A third of the rows in one key, most of them at one time."""
    rng = random.Random(1)
    made = [(7, i, 5_000 if i % 5 else rng.randrange(9_000)) for i in range(3_000)]
    made += [(100 + i % 400, i, rng.randrange(9_000)) for i in range(3_000, 9_000)]
    return made, spark.createDataFrame(made, "k long, id long, o long").repartition(4)


@pytest.mark.parametrize("width", [1 << 16, 100, 1])
def test_numbers_are_dense_under_ties(spark, width):
    made, rows = tied_rows(spark)
    got = {r.id: r.n for r in dense_number(rows, F.col("o"), F.col("id"), "n", width).collect()}
    assert got == {i: n for n, (_, i, _) in enumerate(sorted(made, key=lambda r: (r[2], r[1])), 1)}


def test_numbers_follow_parts_of_a_second(spark):
    rows = spark.sql("SELECT id, timestamp_micros(1700000000000000 + (id * 7919 % 1000) * 1000) AS at FROM range(1000)")
    got = sorted((r.n, r.id * 7919 % 1000) for r in dense_number(rows, F.col("at"), F.col("id"), "n").collect())
    assert got == [(i + 1, i) for i in range(1000)]


@pytest.mark.parametrize("width", [1 << 20, 100, 1])
def test_latest_row_under_ties(spark, width):
    made, rows = tied_rows(spark)
    facts = [(k, i, o + 1) for k, i, o in made if i % 3 == 0]
    left = rows.where("id % 3 <> 0").unionByName(spark.createDataFrame([(None, -1, 5), (None, -2, 5)], "k long, id long, o long"))
    right = spark.createDataFrame(facts, "k long, id long, o long")
    found = asof_lookup(left, right, "k", F.col("o"), F.col("o"), F.col("id"), "id", width)
    got = {r.id: r.found and (r.found.o, r.found.id) for r in found.collect()}
    by_key = {}
    for k, i, o in facts:
        by_key.setdefault(k, []).append((o, i))
    want = {i: max((f for f in by_key.get(k, []) if f[0] <= o), default=None) for k, i, o in made if i % 3}
    assert got == want | {-1: None, -2: None}
