"""Random logs against row-at-a-time replays, with cells of several widths."""

import random
from datetime import timedelta

import pytest
from replay import T0, idle_stop, random_log, replay

from fleetlens.operators import lifecycle
from fleetlens.operators.traffic import mark_reuse

LOG = "seq long, ts timestamp_ntz, session_key long, kind string, address string, application_id string"


def frames(spark, log, keys):
    created = {k: T0 for k in keys}
    return (
        spark.createDataFrame(log, LOG).repartition(3),
        spark.createDataFrame(list(created.items()), "session_key long, created_at timestamp_ntz"),
        created,
    )


def test_fold_equals_replay(spark):
    log = random_log(1, sessions=400, events=2000)
    events, _, _ = frames(spark, log, [])
    status, _ = replay(log, {k: T0 for k in {row[2] for row in log}})
    assert {r[0]: tuple(r)[1:] for r in lifecycle.fold_lifecycle(events).collect()} == status


@pytest.mark.parametrize("width", [1 << 16, 150, 7, 1])
def test_history_equals_replay(spark, width):
    log = random_log(2, sessions=60, events=1500, hot_share=0.34)
    events, created_df, created = frames(spark, log, range(60))
    _, history = replay(log, created)
    got = {}
    for r in lifecycle.session_history(events, created_df, width).collect():
        got.setdefault(r.session_key, []).append(
            [r.seq, r.valid_from, r.valid_to, r.state, r.address, r.application_id]
        )
    for spans in got.values():
        spans.sort(key=lambda s: -1 if s[0] is None else s[0])
    assert got == history


@pytest.mark.parametrize("width", [1 << 16, 13, 1])
def test_history_never_runs_backwards(spark, width):
    """The log arrives out of order in time, and many events share a time."""
    rng = random.Random(12)
    log = [(seq, T0 + timedelta(seconds=rng.randrange(40)), *rest) for seq, _, *rest in random_log(6, sessions=12, events=600, hot_share=0.34)]
    events, created_df, created = frames(spark, log, range(12))
    latest, ordered = dict(created), []
    for seq, ts, key, *rest in log:
        latest[key] = max(latest[key], ts)
        ordered.append((seq, latest[key], key, *rest))
    _, history = replay(ordered, created)
    got = {}
    for r in lifecycle.session_history(events, created_df, width).collect():
        assert r.valid_to is None or r.valid_from <= r.valid_to
        got.setdefault(r.session_key, []).append([r.seq, r.valid_from, r.valid_to, r.state, r.address, r.application_id])
    for spans in got.values():
        spans.sort(key=lambda s: -1 if s[0] is None else s[0])
    assert got == history
    fold = {r[0]: tuple(r)[1:] for r in lifecycle.fold_lifecycle(events).collect()}
    assert fold == {key: tuple(spans[-1][3:]) for key, spans in got.items() if key in fold}


@pytest.mark.parametrize("timeout_s", [0, 1, 59, 60, 61, 300, 3600])
def test_idle_equals_replay(spark, timeout_s):
    rng = random.Random(timeout_s)
    until = T0 + timedelta(seconds=20_000)
    rows, want = [], []
    for key in range(60):
        activity = []
        for _ in range(rng.randrange(0, 9)):
            start = T0 + timedelta(seconds=rng.randrange(0, 9000), microseconds=rng.choice([0, 0, 1, 999_999]))
            length = rng.choice([0, 0, 1, 59, 60, 61, rng.randrange(4000)])
            activity.append((start, start + timedelta(seconds=length)))
        controls = [T0 + timedelta(seconds=rng.randrange(0, 9000)) for _ in range(rng.randrange(0, 3))]
        rows += [(key, a, b, None) for a, b in activity] + [(key, c, c, "health") for c in controls]
        starts = [a for a, _ in activity] + controls
        if starts:
            stop = idle_stop(activity, min(starts), timeout_s, until)
            late = sum(1 for a, _ in activity if stop is not None and a > stop)
            want.append((key, min(starts), stop, len(activity), late))
    frame = spark.createDataFrame(rows, "session_key long, start_ts timestamp_ntz, end_ts timestamp_ntz, control string")
    got = sorted(tuple(r) for r in lifecycle.idle_sessions(frame, timeout_s, until).collect())
    assert got == want


@pytest.mark.parametrize("width", [3600 * 10**6, 90 * 10**6, 10**6])
def test_launch_timeouts_equal_brute_force(spark, width):
    rng = random.Random(5)
    timeout, until = 300, T0 + timedelta(seconds=4000)
    facts = [
        (0 if rng.random() < 0.34 else rng.randrange(20), T0 + timedelta(seconds=rng.randrange(4400)), rng.choice("lllce"))
        for _ in range(600)
    ]
    launches = [(k, i, ts) for i, (k, ts, what) in enumerate(facts) if what == "l"]
    want = []
    for key, launch, ts in launches:
        if ts > until:
            continue
        later = {w: [t for k, t, what in facts if k == key and what == w and ts <= t <= until] for w in "ce"}
        callback, left = min(later["c"], default=None), min(later["e"], default=None)
        deadline = ts + timedelta(seconds=timeout)
        fails = min(deadline, left) if left else deadline
        if callback and callback <= fails:
            outcome = "registered"
        elif left and left <= deadline:
            outcome = "exited"
        else:
            outcome = "timed_out" if deadline <= until else "pending"
        failed = fails if outcome in ("exited", "timed_out") else None
        want.append((key, launch, ts, callback, failed, outcome, bool(failed and callback)))
    events = "session_key long, ts timestamp_ntz"
    got = lifecycle.launch_timeouts(
        spark.createDataFrame(launches, "session_key long, launch_id long, ts timestamp_ntz"),
        spark.createDataFrame([(k, t) for k, t, w in facts if w == "c"], events),
        spark.createDataFrame([(k, t) for k, t, w in facts if w == "e"], events),
        timeout,
        until,
        width,
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("width", [3600 * 10**6, 30 * 10**6, 10**6])
def test_reuse_equals_replay(spark, width):
    rng = random.Random(9)
    facts = []
    for i in range(500):
        key = 0 if rng.random() < 0.34 else rng.randrange(20)
        facts.append((key, T0 + timedelta(seconds=rng.randrange(300)), rng.random() < 0.8, i))
    born = {key: T0 + timedelta(seconds=20 * (key % 4)) for key in range(19)}
    open_tokens, want = set(), []
    for key, ts, is_request, i in sorted(facts, key=lambda f: (f[1], f[2], f[3])):
        if is_request and (key not in born or born[key] > ts):
            continue
        if is_request:
            want.append((key, i, ts, key in open_tokens))
            open_tokens.add(key)
        else:
            open_tokens.discard(key)
    requests = spark.createDataFrame([(k, i, t) for k, t, r, i in facts if r], "session_key long, req_id long, ts timestamp_ntz")
    ended = spark.createDataFrame([(k, t) for k, t, r, _ in facts if not r], "session_key long, ts timestamp_ntz")
    created = spark.createDataFrame(list(born.items()), "session_key long, created_at timestamp_ntz")
    got = sorted(tuple(r) for r in mark_reuse(requests, ended, created, width).collect())
    assert got == sorted(want)
