"""Row-at-a-time replays of the rules, to test the set-based jobs against."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)
KINDS = ["register", "unregister", "stop", "connect_failed", "launch_failed", "health_failed"]


def step(status, kind, address, app):
    """(state, address, application_id) after one event."""
    state, old_address, old_app = status
    if kind == "register":
        return ("RUNNING", address, app)
    if kind in ("unregister", "stop"):
        return ("FINISHED", None, old_app)
    if kind == "connect_failed":
        return ("FAILED", None, old_app)
    if kind == "launch_failed":
        return ("FAILED", old_address, old_app) if state == "LAUNCHING" else status
    return ("FAILED", None, old_app) if state == "RUNNING" else status


def random_log(seed, sessions, events, hot_share=0.0):
    """(seq, ts, session_key, kind, address, application_id); session 0 gets ``hot_share`` of the events."""
    rng = random.Random(seed)
    log = []
    for seq in range(events):
        key = 0 if rng.random() < hot_share else rng.randrange(sessions)
        kind = rng.choice(KINDS)
        registers = kind == "register"
        log.append(
            (
                seq,
                T0 + timedelta(seconds=seq + rng.random()),
                key,
                kind,
                f"h{rng.randrange(3)}:1" if registers else None,
                f"app{rng.randrange(2)}" if registers else None,
            )
        )
    return log


def replay(log, created):
    """Final status per session, and its history."""
    status = {key: ("LAUNCHING", None, None) for key in created}
    history = {key: [[None, at, None, *status[key]]] for key, at in created.items()}
    for seq, ts, key, kind, address, app in sorted(log):
        new = step(status[key], kind, address, app)
        if new != status[key]:
            history[key][-1][2] = ts
            history[key].append([seq, ts, None, *new])
            status[key] = new
    return status, history


def idle_stop(activity, t0, timeout_s, until):
    """First look at which the session is stopped; ``activity`` holds (start, end) of non-control rows."""
    last, look = t0, 0
    pending = sorted(activity)
    while True:
        look += 1
        tick = t0 + timedelta(seconds=60 * look)
        if tick > until:
            return None
        for start, end in pending:
            if start <= tick:
                last = max(last, start)
        if any(start <= tick < end for start, end in pending):
            last = max(last, tick)
        elif last < tick - timedelta(seconds=timeout_s):
            return tick
