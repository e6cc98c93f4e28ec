"""Request resolution against brute force, with cells of several widths."""

import math
import random
from datetime import timedelta

import pytest
from replay import T0, random_log, replay

from fleetlens.operators import lifecycle
from fleetlens.operators.resolution import (
    connect_runs,
    one_session_per_token,
    request_outcomes,
    resolve_against_snapshot,
    resolve_cached_requests,
    resolve_requests,
    with_connect_failures,
)

REQUESTS = "req_id long, ts timestamp_ntz, session_key long, path string, auth_header string, conn_token string"
CONNECT = "/spark.connect.SparkConnectService/Config"


def status_at(spans, ts):
    for _, start, end, state, address, _ in spans:
        if start <= ts and (end is None or ts < end):
            return state, address
    return None, None


def answer(request, history):
    _, ts, key, path, header, conn = request
    if header is None:
        return "unauthenticated", None, None, None
    spans = history.get(key, [])
    if not spans or spans[0][1] > ts:
        return "not_found", None, None, None
    if header != f"Bearer {conn}":
        return "token_mismatch", None, None, None
    _, _, left, *_ = spans[0]
    if left is None:
        return "pending", None, None, None
    at = ts
    if ts < left:
        at = ts + timedelta(seconds=math.ceil((left - ts) / timedelta(microseconds=1) / 1_000_000))
    state, address = status_at(spans, at)
    if state is None:
        return "not_found", None, None, at
    outcome = ("ok" if address else "no_address") if state == "RUNNING" else "bad_state"
    return outcome, state, f"http://{address}{path}" if outcome == "ok" else None, at


@pytest.mark.parametrize("width", [3600 * 10**6, 60 * 10**6, 10**6])
def test_resolution_equals_brute_force(spark, width):
    rng = random.Random(3)
    log = random_log(4, sessions=40, events=900, hot_share=0.34)
    created = {k: T0 + timedelta(seconds=(k * 3) % 50) for k in range(40)}
    log = [row for row in log if row[1] >= created[row[2]] and row[2] != 39]
    _, history = replay(log, created)
    requests = []
    for i in range(700):
        key = 0 if rng.random() < 0.34 else rng.choice([*range(44), None])
        header = rng.choice([None, "Bearer t", "Bearer t", "Bearer t", "Bearer u"])
        requests.append((i, T0 + timedelta(milliseconds=rng.randrange(950_000)), key, CONNECT, header, "t"))
    want = sorted(
        (r[0], r[2] if r[4] else None, *answer(r, history)) for r in requests
    )
    events = spark.createDataFrame(
        log, "seq long, ts timestamp_ntz, session_key long, kind string, address string, application_id string"
    )
    made = spark.createDataFrame(list(created.items()), "session_key long, created_at timestamp_ntz")
    past = lifecycle.session_history(events, made, 50)
    frame = spark.createDataFrame(requests, REQUESTS)
    got = sorted(tuple(r) for r in resolve_requests(frame, past, width=width).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g == w


def test_requests_follow_the_order_of_arrival(spark):
    """The end arrives after the start but carries an earlier time."""
    events = spark.createDataFrame(
        [(1, T0 + timedelta(seconds=10), 1, "register", "h:1", "a"), (2, T0 + timedelta(seconds=8), 1, "unregister", None, None)],
        "seq long, ts timestamp_ntz, session_key long, kind string, address string, application_id string",
    )
    made = spark.createDataFrame([(1, T0)], "session_key long, created_at timestamp_ntz")
    requests = spark.createDataFrame([(1, T0 + timedelta(hours=1), 1, CONNECT, "Bearer t", "t")], REQUESTS)
    assert [r.outcome for r in resolve_requests(requests, lifecycle.session_history(events, made)).collect()] == ["bad_state"]


def test_row_gone_while_waiting_is_not_found(spark):
    """A history that ends without a successor: the row was pruned."""
    history = spark.createDataFrame(
        [(1, None, T0, T0 + timedelta(seconds=5), "LAUNCHING", None)],
        "session_key long, seq long, valid_from timestamp_ntz, valid_to timestamp_ntz, state string, address string",
    )
    requests = spark.createDataFrame([(1, T0 + timedelta(seconds=1), 1, CONNECT, "Bearer t", "t")], REQUESTS)
    assert [r.outcome for r in resolve_requests(requests, history).collect()] == ["not_found"]


def test_hot_token_in_a_snapshot(spark):
    calls = spark.range(900).selectExpr(
        "id AS req_id",
        f"'{CONNECT}' AS path",
        "CASE WHEN id % 3 = 0 THEN 'Bearer hot' WHEN id % 3 = 1 THEN concat('Bearer t', id % 50) END AS auth_header",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 50) END AS conn_token",
    )
    registry = spark.range(30).selectExpr(
        "id", "if(id = 29, 'hot', concat('t', id)) AS token", "'RUNNING' AS state", "concat('h:', id) AS address"
    )
    sessions = one_session_per_token(registry)
    plain = sorted(map(repr, resolve_against_snapshot(calls, sessions, salts=1).collect()))
    assert len(plain) == 900
    for salts in (3, 16):
        assert sorted(map(repr, resolve_against_snapshot(calls, sessions, salts).collect())) == plain


def test_snapshot_takes_the_lowest_id_of_a_token(spark):
    registry = spark.createDataFrame(
        [
            (1, "t", "RUNNING", "h:1"),
            (2, "t", "FAILED", None),
            (3, "u", "LAUNCHING", None),
            (4, "v", "RUNNING", None),
            (5, "w", "FINISHED", None),
        ],
        "id long, token string, state string, address string",
    )
    heads = ["Bearer t", "Bearer u", "Bearer v", "Bearer w", "Bearer x", None, "Basic t"]
    requests = spark.createDataFrame(
        [(i, CONNECT, h, h and h.split(" ")[1]) for i, h in enumerate(heads)],
        "req_id long, path string, auth_header string, conn_token string",
    )
    got = {r.req_id: (r.id, r.outcome, r.target) for r in resolve_against_snapshot(requests, one_session_per_token(registry)).collect()}
    assert got == {
        0: (1, "ok", f"http://h:1{CONNECT}"),
        1: (3, "waiting", None),
        2: (4, "no_address", None),
        3: (5, "bad_state", None),
        4: (None, "not_found", None),
        5: (None, "unauthenticated", None),
        6: (None, "unauthenticated", None),
    }


def cached_replay(requests, history, ended):
    """The dispatcher of a token, request by request: it keeps its connection until an invalidation, and handles one request at a time."""
    out, kept = [], {}
    for req_id, ts, key, path, header, conn in sorted(requests, key=lambda r: (r[1], r[0])):
        session = key if header else None
        spans = history.get(key, [])
        if header is None:
            out.append((req_id, session, "unauthenticated", None, None, None, None))
            continue
        if not spans or spans[0][1] > ts:
            out.append((req_id, session, "not_found", None, None, None, None))
            continue
        if header != f"Bearer {conn}":
            out.append((req_id, session, "token_mismatch", None, None, None, None))
            continue
        generation = sum(e <= ts for e in ended.get(key, []))
        now = kept.setdefault((key, generation), {"address": None, "by": None, "opened": None, "busy": ts})
        if now["address"]:
            out.append((req_id, session, "ok", None, f"http://{now['address']}{path}", max(ts, now["opened"]), now["by"]))
            continue
        left = spans[0][2]
        if left is None:
            out.append((req_id, session, "pending", None, None, None, None))
            continue
        at = max(ts, now["busy"])
        if at < left:
            at += timedelta(seconds=math.ceil((left - at) / timedelta(microseconds=1) / 1_000_000))
        now["busy"] = at
        if any(ts < e <= at for e in ended.get(key, [])):
            out.append((req_id, session, "not_found", None, None, at, None))
            continue
        state, address = status_at(spans, at)
        if state == "RUNNING" and address:
            now.update(address=address, by=req_id, opened=at)
            out.append((req_id, session, "ok", state, f"http://{address}{path}", at, req_id))
        else:
            outcome = "not_found" if state is None else "no_address" if state == "RUNNING" else "bad_state"
            out.append((req_id, session, outcome, state, None, at, None))
    return sorted(out)


@pytest.mark.parametrize("seed, width", [(3, 3600 * 10**6), (3, 60 * 10**6), (4, 10**6), (5, 60 * 10**6)])
def test_cached_resolution_equals_a_replay_with_a_cache(spark, seed, width):
    rng = random.Random(seed)
    log = random_log(seed, sessions=40, events=700, hot_share=0.3)
    created = {k: T0 + timedelta(milliseconds=(k * 3331) % 50_000) for k in range(40)}
    log = [row for row in log if row[1] >= created[row[2]] and row[2] != 39]
    _, history = replay(log, created)
    ended = {}
    for _, ts, key, kind, *_ in log:
        if kind in ("unregister", "stop"):
            ended.setdefault(key, []).append(ts)
    requests = []
    for i in range(900):
        key = 0 if rng.random() < 0.34 else rng.choice([*range(44), None])
        header = rng.choice([None, "Bearer t", "Bearer t", "Bearer t", "Bearer t", "Bearer u"])
        requests.append((i, T0 + timedelta(milliseconds=rng.randrange(720_000)), key, CONNECT, header, "t"))
    events = spark.createDataFrame(log, "seq long, ts timestamp_ntz, session_key long, kind string, address string, application_id string")
    made = spark.createDataFrame(list(created.items()), "session_key long, created_at timestamp_ntz")
    past = lifecycle.session_history(events, made, 50)
    invalidations = events.where("kind IN ('unregister', 'stop')").select("session_key", "ts")
    got = sorted(tuple(r) for r in resolve_cached_requests(spark.createDataFrame(requests, REQUESTS), past, invalidations, width).collect())
    want = cached_replay(requests, history, ended)
    assert got == want
    cached = [w for w in want if w[6] not in (None, w[0])]
    assert len(cached) > 50


def test_a_failed_session_answers_until_it_is_invalidated(spark):
    log = [
        (1, T0 + timedelta(seconds=10), 1, "register", "h:1", "a"),
        (2, T0 + timedelta(seconds=20), 1, "health_failed", None, None),
        (3, T0 + timedelta(hours=5), 1, "stop", None, None),
    ]
    events = spark.createDataFrame(log, "seq long, ts timestamp_ntz, session_key long, kind string, address string, application_id string")
    made = spark.createDataFrame([(1, T0)], "session_key long, created_at timestamp_ntz")
    times = [5, 12, 30, 4 * 3600, 6 * 3600]
    requests = spark.createDataFrame([(i, T0 + timedelta(seconds=s), 1, CONNECT, "Bearer t", "t") for i, s in enumerate(times)], REQUESTS)
    past = lifecycle.session_history(events, made)
    ends = events.where("kind = 'stop'").select("session_key", "ts")
    got = {r.req_id: (r.outcome, r.opened_by) for r in resolve_cached_requests(requests, past, ends).collect()}
    assert got == {0: ("ok", 0), 1: ("ok", 0), 2: ("ok", 0), 3: ("ok", 0), 4: ("bad_state", None)}
    assert [r.outcome for r in resolve_requests(requests, past).orderBy("req_id").collect()] == ["ok", "ok", "bad_state", "bad_state", "bad_state"]


@pytest.mark.parametrize("width", [3600 * 10**6, 10**6])
def test_connect_failures_against_brute_force(spark, width):
    rng = random.Random(8)
    resolved, attempts = [], []
    for i in range(400):
        key = 0 if rng.random() < 0.34 else rng.randrange(20)
        at = T0 + timedelta(seconds=rng.randrange(3000))
        outcome = rng.choice(["ok", "ok", "ok", "bad_state"])
        resolved.append((i, key, outcome, "RUNNING", "http://h:1/x" if outcome == "ok" else None, at))
        if outcome == "ok" and rng.random() < 0.7:
            start = at + timedelta(milliseconds=rng.randrange(900))
            failures = rng.randrange(5)
            attempts += [(key, start + timedelta(seconds=k), k + 1, False) for k in range(failures)]
            if failures < 4 and rng.random() < 0.9:
                attempts.append((key, start + timedelta(seconds=failures), failures + 1, True))
    attempts.append((99, T0, 3, False))
    runs = {}
    for key, ts, n, ok in attempts:
        begun = [t for k, t, m, _ in attempts if k == key and m == 1 and t <= ts]
        if begun:
            runs.setdefault((key, max(begun)), []).append((n, ok))
    want_runs = sorted((k, t, len(a), {n for n, _ in a} == {1, 2, 3, 4} and not any(ok for _, ok in a)) for (k, t), a in runs.items())
    broken = set()
    for key, started, _, failed in want_runs:
        sent = [(r[5], r[0]) for r in resolved if r[1] == key and r[2] == "ok" and r[5] <= started]
        if failed and sent:
            broken.add(max(sent)[1])
    frame = spark.createDataFrame(resolved, "req_id long, session_key long, outcome string, state string, target string, answered_at timestamp_ntz")
    tries = spark.createDataFrame(attempts, "session_key long, ts timestamp_ntz, attempt int, ok boolean").repartition(3)
    found = connect_runs(tries, width)
    assert sorted(tuple(r) for r in found.collect()) == want_runs
    got = with_connect_failures(frame, found, width)
    assert {r.req_id for r in got.where("outcome = 'upstream_connect'").collect()} == broken and len(broken) > 20
    assert got.where("outcome = 'upstream_connect' AND target IS NOT NULL").count() == 0
    codes = {r.outcome: (r.code, r.requests) for r in request_outcomes(got).collect()}
    assert codes["upstream_connect"] == (14, len(broken))
