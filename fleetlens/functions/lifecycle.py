"""The lifecycle rule table as expressions.

Only two kinds of event look at the old state, so the end state of any run of events follows from
five facts that aggregate associatively: the last unguarded event, the number of the last health
failure, whether a launch failure occurred, and the last register's application id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import schemas as S

UNGUARDED = f"kind IN ({', '.join(repr(kind) for kind in S.UNGUARDED_KINDS)})"


def state_after(kind: str) -> str:
    """SQL for the state set by an event that takes effect."""
    return f"""CASE {kind} WHEN '{S.CREATE}' THEN '{S.LAUNCHING}' WHEN '{S.REGISTER}' THEN '{S.RUNNING}'
        WHEN '{S.UNREGISTER}' THEN '{S.FINISHED}' WHEN '{S.STOP}' THEN '{S.FINISHED}' ELSE '{S.FAILED}' END"""


def fold_facts(order: str) -> list[Column]:
    """Aggregates over any part of a session's log; ``order`` is SQL for the arrival number."""
    return [
        F.expr(f"max_by(struct(kind, address, {order} AS at), CASE WHEN {UNGUARDED} THEN {order} END) AS last_set"),
        F.expr(f"max(CASE WHEN kind = '{S.HEALTH_FAILED}' THEN {order} END) AS last_health"),
        F.expr(f"max(kind = '{S.LAUNCH_FAILED}') AS launch_failed"),
        F.expr(f"max_by(struct(application_id), CASE WHEN kind = '{S.REGISTER}' THEN {order} END) AS last_app"),
    ]


_STATE = f"""CASE
    WHEN last_set IS NULL THEN if(launch_failed, '{S.FAILED}', '{S.LAUNCHING}')
    WHEN last_set.kind = '{S.REGISTER}' AND last_health > last_set.at THEN '{S.FAILED}'
    ELSE {state_after("last_set.kind")} END"""


def end_state() -> list[Column]:
    """State, address and application id from the aggregates of ``fold_facts``."""
    return [
        F.expr(f"{_STATE} AS state"),
        F.expr(f"CASE WHEN {_STATE} = '{S.RUNNING}' THEN last_set.address END AS address"),
        F.expr("last_app.application_id AS application_id"),
    ]
