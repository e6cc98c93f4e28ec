"""From a request to the session behind it, as the proxy would answer it without and with the connections it keeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions.clock import SECOND, ceil_div, micros, plus_seconds
from fleetlens.functions.headers import grpc_token, has_grpc_token
from fleetlens.plans.asof import asof_lookup
from fleetlens.plans.cells import TIME_CELL, salted_lookup


def _mismatch() -> Column:
    return F.coalesce(F.col("_token") != F.col("conn_token"), F.lit(False))


def _target(address: Column) -> Column:
    """The session's address with the path and query of the request."""
    path = F.when(F.length("path") > 0, F.col("path")).otherwise("/")
    return F.concat(F.lit("http://"), address, path)


def launch_windows_of(history: DataFrame) -> DataFrame:
    """Creation and end of LAUNCHING per session, from its history."""
    return history.where(F.col("state") == S.LAUNCHING).select(
        "session_key", F.col("valid_from").alias("created_at"), F.col("valid_to").alias("launch_end")
    )


def resolve_requests(
    requests: DataFrame,
    history: DataFrame,
    windows: DataFrame | None = None,
    width: int = TIME_CELL,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Outcome, state and target of each request, by the state of its session at that time.

    ``requests(req_id, ts, session_key, path, auth_header, conn_token)``, where ``session_key`` is the session the
    request's token belongs to, null if there is none. ``history`` is that of ``session_history``.
    ``windows`` (creation and end of LAUNCHING per session) are those of ``history`` when not given. ``history`` is read twice, and what
    the requests are looked up in too; ``keep`` may hold the latter, such as by writing it (``plans.shared.stored``).

    A request that meets LAUNCHING polls each second, so it is looked up at its first poll after
    LAUNCHING ends. That time is known once the session is joined on, so one linear as-of pass
    answers waiting and other requests alike.
    """
    key = "session_key"
    at = micros(F.col("ts"))
    if windows is None:
        windows = launch_windows_of(history)
    passes = has_grpc_token(F.col("auth_header"))
    parsed = requests.select(
        "req_id",
        "ts",
        F.when(passes, F.col(key)).alias(key),
        "path",
        grpc_token(F.col("auth_header")).alias("_token"),
        "conn_token",
    )
    found = parsed.join(windows, key, "left")

    known = F.coalesce(F.col("created_at") <= F.col("ts"), F.lit(False))
    waits = F.col("launch_end").isNull() | (F.col("ts") < F.col("launch_end"))
    wait_s = ceil_div(micros(F.col("launch_end")) - at, SECOND)
    early = (
        F.when(F.col("_token").isNull(), "unauthenticated")
        .when(~known, "not_found")
        .when(_mismatch(), "token_mismatch")
        .when(F.col("launch_end").isNull(), "pending")
    )
    looked_up = found.select(
        "req_id",
        "path",
        F.col(key).alias("_session"),
        early.alias("_early"),
        F.when(waits, plus_seconds(F.col("ts"), wait_s)).otherwise(F.col("ts")).alias("answered_at"),
        F.when(early.isNull(), F.col(key)).alias(key),
    )
    facts = history.select(key, "valid_from", micros(F.col("valid_to")).alias("_until"), "state", "address", "seq")
    answered = asof_lookup(
        looked_up,
        facts,
        key,
        left_order=micros(F.col("answered_at")),
        right_order=micros(F.col("valid_from")),
        right_tie=F.expr(f"coalesce(seq, {-(1 << 62)}L)"),
        row_id="req_id",
        width=width,
        keep=keep,
    )
    covered = F.col("found").isNotNull() & (
        F.col("found._until").isNull() | (micros(F.col("answered_at")) < F.col("found._until"))
    )
    state, address = F.col("found.state"), F.col("found.address")
    outcome = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(~covered, "not_found")
        .when((state == S.RUNNING) & address.isNotNull(), "ok")
        .when(state == S.RUNNING, "no_address")
        .when(state == S.LAUNCHING, "pending")
        .otherwise("bad_state")
    )
    return (
        answered.withColumn("outcome", outcome)
        .withColumn("_state", F.when(F.col("_early").isNull() & covered, state))
        .select(
            "req_id",
            F.col("_session").alias(key),
            "outcome",
            F.col("_state").alias("state"),
            F.when(F.col("outcome") == "ok", _target(address)).alias("target"),
            F.when(F.col("_early").isNull(), F.col("answered_at")).alias("answered_at"),
        )
    )


def resolve_cached_requests(
    requests: DataFrame,
    history: DataFrame,
    invalidations: DataFrame,
    width: int = TIME_CELL,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """As ``resolve_requests``, but with the connection a token keeps: columns of that, and ``opened_by``.

    ``invalidations(session_key, ts)`` (unregister and stop) end a generation of a session's requests. The first request of a generation that finds a
    session RUNNING with an address opens the connection, and later ones of the generation go there whatever has become of the session; ``opened_by``
    is the opening request. Requests are handled one after the other: those that come while the first one waits for LAUNCHING to end are looked up when
    it is. If the generation is over by then, they are ``not_found``. State is what a request saw itself, null if it went to an open connection.

    Two levels: every request is looked up at its own time, per (session, cell) as there, and so is the invalidation before it. A generation's
    opener is then the least of its requests that may open, an aggregate that no cell bounds, joined back on (session, generation).
    """
    key = "session_key"
    at = micros(F.col("ts"))
    ended = invalidations.groupBy(key).agg(F.min("ts").alias("_first_end"))
    sessions = launch_windows_of(history).join(ended, key, "left")
    passes = has_grpc_token(F.col("auth_header"))
    parsed = requests.select(
        "req_id", "ts", F.when(passes, F.col(key)).alias(key), "path", grpc_token(F.col("auth_header")).alias("_token"), "conn_token"
    )
    known = F.coalesce(F.col("created_at") <= F.col("ts"), F.lit(False))
    early = F.when(F.col("_token").isNull(), "unauthenticated").when(~known, "not_found").when(_mismatch(), "token_mismatch")
    found = parsed.join(sessions, key, "left").withColumn("_early", early)
    first = found.where("_early IS NULL").groupBy(key).agg(F.min("ts").alias("_first_ts"))
    found = found.join(first, key, "left")
    wait_s = ceil_div(micros(F.col("launch_end")) - micros(F.col("_first_ts")), SECOND)
    first_answer = F.when(F.col("_first_ts") < F.col("launch_end"), plus_seconds(F.col("_first_ts"), wait_s))
    waiting = F.col("_early").isNull() & (F.col("ts") < F.col("_free_at"))
    early = F.coalesce("_early", F.when(F.col("launch_end").isNull(), "pending"))
    asked = (
        found.withColumn("_free_at", first_answer)
        .withColumn("answered_at", F.when(waiting, F.col("_free_at")).otherwise(F.col("ts")))
        .withColumn("_over", F.coalesce(F.col("_early").isNull() & (F.col("ts") < F.col("_first_end")) & (F.col("_first_end") <= F.col("answered_at")), F.lit(False)))
        .withColumn("_early", F.coalesce(early, F.when(F.col("_over"), "not_found")))
        .select("req_id", "ts", "path", F.col(key).alias("_session"), "_early", "_over", "answered_at", F.when(F.col("_early").isNull(), F.col(key)).alias(key))
    )
    facts = history.select(key, "valid_from", micros(F.col("valid_to")).alias("_until"), "state", "address", "seq")
    status = asof_lookup(
        asked,
        facts,
        key,
        left_order=micros(F.col("answered_at")),
        right_order=micros(F.col("valid_from")),
        right_tie=F.expr(f"coalesce(seq, {-(1 << 62)}L)"),
        row_id="req_id",
        width=width,
        keep=keep,
    )
    covered = F.col("found").isNotNull() & (F.col("found._until").isNull() | (micros(F.col("answered_at")) < F.col("found._until")))
    looked_up = status.withColumns(
        {"_state": F.when(F.col("_early").isNull() & covered, F.col("found.state")), "_address": F.when(covered, F.col("found.address"))}
    ).drop("found")
    ends = invalidations.select(key, F.col("ts").alias("_end"), F.lit(0).alias("_tie"))
    placed = asof_lookup(looked_up, ends, key, left_order=at, right_order=micros(F.col("_end")), right_tie=F.col("_tie"), row_id="req_id", width=width, keep=keep)
    placed = placed.withColumn("_generation", F.coalesce(micros(F.col("found._end")), F.lit(-(1 << 62)))).drop("found")
    opens = (F.col("_state") == S.RUNNING) & F.col("_address").isNotNull()
    order = F.struct("ts", "req_id")
    openers = placed.where(opens).groupBy(key, "_generation").agg(F.min_by(F.struct("ts", "req_id", "answered_at", "_address"), order).alias("_by"))
    joined = placed.join(openers, [key, "_generation"], "left")
    cached = F.col("_early").isNull() & F.col("_by").isNotNull() & (F.struct("ts", "req_id") > F.struct("_by.ts", "_by.req_id"))
    own = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_state").isNull(), "not_found")
        .when(opens, "ok")
        .when(F.col("_state") == S.RUNNING, "no_address")
        .when(F.col("_state") == S.LAUNCHING, "pending")
        .otherwise("bad_state")
    )
    answered = F.col("_early").isNull() | F.col("_over")
    return joined.withColumn("_cached", cached).select(
        "req_id",
        F.col("_session").alias(key),
        F.when(F.col("_cached"), "ok").otherwise(own).alias("outcome"),
        F.when(~F.col("_cached"), F.col("_state")).alias("state"),
        F.when(F.col("_cached") | opens, _target(F.when(F.col("_cached"), F.col("_by._address")).otherwise(F.col("_address")))).alias("target"),
        F.when(F.col("_cached"), F.greatest("ts", "_by.answered_at")).when(answered, F.col("answered_at")).alias("answered_at"),
        F.when(F.col("_cached") | opens, F.col("_by.req_id")).alias("opened_by"),
    )


def connect_runs(attempts: DataFrame, width: int = TIME_CELL) -> DataFrame:
    """Runs of connection attempts: session_key, started_at, attempts, failed.

    ``attempts(session_key, ts, attempt, ok)``. A run begins with attempt 1 and has the attempts up to the next one; it has failed once all
    four were made and none succeeded. Attempts without a beginning belong to no run.
    """
    key = "session_key"
    numbered = attempts.where(F.col("attempt").between(1, S.MAX_ATTEMPTS)).select(
        key, "ts", "attempt", "ok", F.monotonically_increasing_id().alias("_row")
    )
    starts = numbered.where("attempt = 1").select(key, F.col("ts").alias("started_at"), "attempt")
    tied = asof_lookup(numbered, starts, key, micros(F.col("ts")), micros(F.col("started_at")), F.col("attempt"), "_row", width)
    bits = F.bit_or(F.when(~F.col("ok"), F.call_function("shiftleft", F.lit(1), F.col("attempt").cast("int"))))
    all_failed = sum(1 << n for n in range(1, S.MAX_ATTEMPTS + 1))
    return (
        tied.where("found IS NOT NULL")
        .groupBy(key, F.col("found.started_at").alias("started_at"))
        .agg(F.count(F.lit(1)).alias("attempts"), (~F.bool_or("ok") & (bits == all_failed)).alias("failed"))
        .withColumn("failed", F.coalesce("failed", F.lit(False)))
    )


def with_connect_failures(resolved: DataFrame, runs: DataFrame, width: int = TIME_CELL) -> DataFrame:
    """``resolved`` requests, those whose connection attempts all failed being ``upstream_connect``, without a target.

    A run of attempts belongs to the last request of its session that was sent on when the run began.
    """
    key = "session_key"
    failed = runs.where("failed").select(key, "started_at", F.monotonically_increasing_id().alias("_run"))
    sent = resolved.where("outcome = 'ok'").select(key, "req_id", "answered_at")
    tied = asof_lookup(failed, sent, key, micros(F.col("started_at")), micros(F.col("answered_at")), F.col("req_id"), "_run", width)
    broken = tied.where("found IS NOT NULL").select(F.col("found.req_id").alias("req_id"), F.lit(True).alias("_broken")).distinct()
    marked = resolved.join(broken, "req_id", "left")
    return marked.select(
        *(c for c in resolved.columns if c not in ("outcome", "target")),
        F.when(F.col("_broken"), "upstream_connect").otherwise(F.col("outcome")).alias("outcome"),
        F.when(F.col("_broken").isNull(), F.col("target")).alias("target"),
    ).select(*resolved.columns)


def one_session_per_token(registry: DataFrame) -> DataFrame:
    """Tokens aren't unique by schema; a lookup takes one row, here the lowest id."""
    return (
        registry.groupBy("token")
        .agg(F.min_by(F.struct("id", "state", "address"), "id").alias("_s"))
        .select(
            "token",
            F.col("_s.id").alias("id"),
            F.col("_s.state").alias("state"),
            F.col("_s.address").alias("address"),
        )
    )


def resolve_against_snapshot(requests: DataFrame, sessions: DataFrame, salts: int = 1) -> DataFrame:
    """As ``resolve_requests``, but by the state as it is now; LAUNCHING rows are ``waiting``.

    ``sessions(token, id, state, address)`` has one row per token (``one_session_per_token``). Requests may be a stream.
    Requests without a token are spread over all tasks, by keys of their own. One salt is a plain join, whose hot tokens AQE splits in batch, and
    leaves a bucketed ``sessions`` table where it is. In a stream with hot tokens, their requests can be spread over several salts.
    """
    parsed = requests.select("req_id", "path", "conn_token", grpc_token(F.col("auth_header")).alias("_token")).withColumn(
        "token", F.coalesce("_token", F.concat(F.lit(" "), F.col("req_id").cast("string")))
    )
    joined = salted_lookup(parsed, sessions, "token", "req_id", salts)
    state, address = F.col("state"), F.col("address")
    outcome = (
        F.when(F.col("_token").isNull(), "unauthenticated")
        .when(F.col("id").isNull(), "not_found")
        .when(_mismatch(), "token_mismatch")
        .when(state == S.LAUNCHING, "waiting")
        .when((state == S.RUNNING) & address.isNotNull(), "ok")
        .when(state == S.RUNNING, "no_address")
        .otherwise("bad_state")
    )
    return joined.withColumn("outcome", outcome).select(
        "req_id",
        "id",
        "outcome",
        F.when(~F.col("outcome").isin("unauthenticated", "not_found", "token_mismatch"), state).alias("state"),
        F.when(F.col("outcome") == "ok", _target(address)).alias("target"),
    )


def outcome_code(outcome: Column) -> Column:
    """gRPC status of an outcome, null while there is no answer."""
    code = F.lit(None).cast("int")
    for name, value in S.OUTCOME_CODES:
        code = F.when(outcome == name, F.lit(value).cast("int")).otherwise(code)
    return code


def request_outcomes(resolved: DataFrame) -> DataFrame:
    """Requests per outcome and gRPC status. The proxy's HTTP status is 200 throughout.

    The status is put on after counting, on one row per outcome.
    """
    return (
        resolved.groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("outcome", outcome_code(F.col("outcome")).alias("code"), "requests")
    )
