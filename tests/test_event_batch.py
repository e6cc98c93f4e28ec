"""A mixed batch on an existing registry against applying its events one by one."""

import random

import pytest
from replay import KINDS, T0, step
from support import SF, rows

from fleetlens import schemas as S
from fleetlens.catalog.fixtures import view
from fleetlens.operators.event_batch import apply_events, effect_counts, event_effects

EVENTS = "seq long, kind string, token string, id long, username string, address string, application_id string"
BY_TOKEN = ("register", "unregister", "connect_failed")


def random_registry(rng, sessions):
    made = []
    for i in range(sessions):
        state = rng.choice(S.STATES)
        address = f"old{i}:1" if state == S.RUNNING and rng.random() < 0.9 or rng.random() < 0.1 else None
        token = "shared" if i % 25 == 24 else f"t{i}"
        made.append((i, T0, f"u{i % 7}", None, state, token, address, rng.choice([None, f"app{i}"])))
    return made


def random_events(rng, sessions, events):
    """A third of the events go to one session; some name no session, or another owner's."""
    made = []
    for seq in range(events):
        i = 3 if rng.random() < 0.34 else rng.randrange(sessions + 5)
        kind = rng.choice(KINDS)
        token = "shared" if i % 25 == 24 else f"t{i}"
        owner = f"u{i % 7}" if rng.random() < 0.8 else "someone"
        register = kind == "register"
        made.append(
            (
                seq * 3,
                kind,
                token if kind in BY_TOKEN else None,
                None if kind in BY_TOKEN else i,
                owner if kind == "stop" else None,
                rng.choice([None, f"h{seq}:1"]) if register else None,
                rng.choice([None, f"a{seq}"]) if register else None,
            )
        )
    return made


def replay_batch(registry, events):
    """The registry after the events, rows set, and what every event found and did."""
    now = {r[0]: list(r) for r in registry}
    hit, effects = set(), []
    for seq, kind, token, ident, owner, address, app in sorted(events):
        found = [r for r in now.values() if (r[5] == token if kind in BY_TOKEN else r[0] == ident and (kind != "stop" or r[2] == owner))]
        if not found:
            effects.append((seq, kind, None, None, False, False, None, None, None, None))
        for row in found:
            before = (row[4], row[6], row[7])
            guard = {"launch_failed": S.LAUNCHING, "health_failed": S.RUNNING}.get(kind)
            effective = guard in (None, row[4])
            row[4], row[6], row[7] = step(before, kind, address, app)
            if effective:
                hit.add(row[0])
            signal = before[1] if kind == "stop" else None
            effects.append((seq, kind, row[0], row[5], True, effective, row[4], row[6], row[7], signal))
    return sorted(map(tuple, now.values()), key=repr), hit, sorted(effects, key=repr)


@pytest.fixture(scope="module")
def batch(spark):
    rng = random.Random(11)
    registry, events = random_registry(rng, 80), random_events(rng, 80, 1200)
    frames = spark.createDataFrame(registry, S.REGISTRY_SCHEMA).repartition(3), spark.createDataFrame(events, EVENTS).repartition(3)
    return registry, events, *frames


def test_registry_equals_replay(batch):
    registry, events, table, log = batch
    want, hit, _ = replay_batch(registry, events)
    applied = apply_events(table, log)
    assert rows(applied.registry) == want
    assert {r.id for r in applied.touched.collect()} == hit


def test_short_batches_one_after_the_other(spark):
    """Each batch starts from the state the last one left."""
    rng = random.Random(12)
    registry, events = random_registry(rng, 30), random_events(rng, 30, 160)
    table = spark.createDataFrame(registry, S.REGISTRY_SCHEMA)
    for a in range(0, len(events), 40):
        table = apply_events(table, spark.createDataFrame(events[a : a + 40], EVENTS)).registry
        table = spark.createDataFrame(table.collect(), S.REGISTRY_SCHEMA)
    assert rows(table) == replay_batch(registry, events)[0]


@pytest.mark.parametrize("width", [1 << 16, 200, 1])
def test_effects_equal_replay(batch, width):
    registry, events, table, log = batch
    assert rows(event_effects(table, log, width)) == replay_batch(registry, events)[2]


def test_marks_and_counts(batch):
    registry, events, table, log = batch
    _, _, effects = replay_batch(registry, events)
    marked = apply_events(table, log).marked
    for kind in KINDS:
        if kind != "health_failed":
            assert sum(r[f"_{kind}"] for r in marked.collect()) == sum(1 for e in effects if e[1] == kind and e[5])
    counted = {r.kind: (r.events, r.matched, r.rows) for r in effect_counts(event_effects(table, log)).collect()}
    for kind in KINDS:
        mine = [e for e in effects if e[1] == kind]
        assert counted[kind] == (len({e[0] for e in mine}), len({e[0] for e in mine if e[4]}), sum(e[5] for e in mine))


def test_nothing_to_apply(spark, batch):
    registry, _, table, log = batch
    applied = apply_events(table, log.where("false"))
    assert rows(applied.registry) == sorted(registry, key=repr)
    assert applied.touched.count() == 0
    assert event_effects(table, log.where("false")).count() == 0
    assert {r.matched for r in event_effects(table.where("false"), log).collect()} == {False}


def test_nulls_match_nothing(spark, batch):
    _, _, table, _ = batch
    odd = [(1, "register", None, 5, None, "h:1", "a"), (2, "stop", None, 5, None, None, None), (3, "health_failed", "t5", None, None, None, None), (4, "bogus", "t5", 5, "u5", None, None), (5, None, "t5", 5, "u5", None, None)]
    log = spark.createDataFrame(odd, EVENTS)
    assert rows(apply_events(table, log).registry) == rows(table)
    assert {(r.matched, r.effective) for r in event_effects(table, log).collect()} == {(False, False)}


def test_the_registry_is_scanned_once(spark, tmp_path):
    path = str(tmp_path / "registry")
    view(spark, SF, "fx_registry").write.parquet(path)
    plan = apply_events(spark.read.parquet(path), view(spark, SF, "fx_mixed_events")).registry._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryFileIndex(1 paths)") == plan.count("FileScan")
    assert sum(str(tmp_path.name) in line for line in plan.splitlines() if "FileScan" in line) == 1
    assert "Window" not in plan and "partial_max_by" in plan
