"""One query per operator, over whole input views. Parameters are fixed literals, never the clock."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.catalog.fixtures import view, view_stream, with_zone, without_zone
from fleetlens.functions.clock import plus_seconds
from fleetlens.functions.headers import has_grpc_token
from fleetlens.functions.routes import is_grpc
from fleetlens.operators import event_batch, launch, lifecycle, registry, resolution, traffic, transitions
from fleetlens.plans.shared import new_folder, stored
from fleetlens.sources.callbacks import parse_callbacks
from fleetlens.sources.history_store import HistoryStore
from fleetlens.sources.registry_store import RegistryStore
from fleetlens.streaming import idle_timer
from fleetlens.streaming.launch_timer import LaunchTimer
from fleetlens.streaming import operators as streaming
from fleetlens.streaming.run import append_to_files, upsert_to_files

Query = Callable[[SparkSession, str], DataFrame]

TIMEOUT_S = 21_600
LAUNCHES_UNTIL = datetime(2024, 1, 31)
ACTIVITY_UNTIL = datetime(2024, 2, 15)
PRUNE_NOW = datetime(2002, 1, 1)
PRUNE_AGE_S = 63_158_400
DELAY = "1 hour"
SERVICE = launch.Service(callback="http://proxy:8100", idle_timeout_s=3600, tarball="/tmp/env.tgz")


def _list_sessions(spark, sf):
    return registry.list_sessions(
        view(spark, sf, "fx_registry"),
        owner="user-5",
        state=" RUNNING, ,FINISHED,",
        created_after="1996-01-01T00:00:00Z",
        created_before="2000-12-31T00:00:00Z",
        ui_template="https://ui.example/{{ application_id }}",
    )


def _lookup_sessions(spark, sf):
    keys = view(spark, sf, "fx_stops").select("username", "id")
    return registry.lookup_sessions(view(spark, sf, "fx_registry"), keys)


def _register_sessions(spark, sf):
    """Launches of a day arrive at different milliseconds."""
    asked_at = plus_seconds(F.col("launched_at"), (F.col("session_id") % 1000) / 1000)
    launches = view(spark, sf, "fx_launches").withColumnRenamed("app_name", "name").withColumn("asked_at", asked_at)
    return registry.register_sessions(
        launches,
        next_id=1_000_000,
        order=F.col("asked_at"),
        tie=F.col("session_id"),
        created_at=F.col("launched_at"),
        token=F.col("token"),
    )


def _token_events(spark, sf, kind):
    return view(spark, sf, "fx_token_events").where(F.col("kind") == kind)


def _registrations(spark, sf):
    return transitions.apply_registrations(view(spark, sf, "fx_registry"), _token_events(spark, sf, S.REGISTER))


def _unregistrations(spark, sf):
    return transitions.apply_unregistrations(view(spark, sf, "fx_registry"), _token_events(spark, sf, S.UNREGISTER))


def _launch_failures(spark, sf, guarded=True):
    return transitions.apply_launch_failures(view(spark, sf, "fx_registry"), _token_events(spark, sf, S.LAUNCH_FAILED), guarded)


def _callbacks(spark, sf):
    """Callback bodies made of the token events: whole, without a field, with a number for a string, and not JSON."""
    body = """CASE seq % 5 WHEN 0 THEN to_json(named_struct('address', address, 'application_id', application_id))
        WHEN 1 THEN to_json(named_struct('address', coalesce(address, ''), 'application_id', 'a "quoted" \\\\ name', 'more', seq))
        WHEN 2 THEN to_json(named_struct('address', 'h:1', 'application_id', seq))
        WHEN 3 THEN concat('{"address": "h:', seq, '"') ELSE to_json(named_struct('address', 'h:1', 'application_id', kind)) END AS body"""
    return parse_callbacks(view(spark, sf, "fx_token_events").selectExpr("seq", "token", body), "body")


def _update_counts(spark, sf):
    """Rows each update sets, as the service reports them."""
    changes = {
        "apply_registrations": _registrations(spark, sf),
        "apply_unregistrations": _unregistrations(spark, sf),
        "apply_stops": _stops(spark, sf),
        "apply_launch_failures": _launch_failures(spark, sf),
        "apply_connect_failures": _connect_failures(spark, sf),
        "health_sweep": _health(spark, sf),
    }
    marked = [change.marked.select(F.lit(name).alias("update"), "_hit") for name, change in changes.items()]
    return reduce(DataFrame.unionByName, marked).groupBy("update").agg(F.count_if("_hit").alias("rows"))


def _stops(spark, sf):
    return transitions.apply_stops(view(spark, sf, "fx_registry"), view(spark, sf, "fx_stops"))


def _connect_failures(spark, sf):
    sessions = view(spark, sf, "fx_registry")
    attempts = view(spark, sf, "fx_probes").join(sessions.select("id", "token"), "id").select("token", "attempt", "ok")
    return transitions.apply_connect_failures(sessions, attempts)


def _health(spark, sf):
    return transitions.health_sweep(view(spark, sf, "fx_registry"), view(spark, sf, "fx_probes"))


def _event_batch(operator, spark, sf):
    return operator(view(spark, sf, "fx_registry"), view(spark, sf, "fx_mixed_events"))


def _prune(spark, sf):
    return transitions.prune_terminal(view(spark, sf, "fx_registry"), PRUNE_NOW, PRUNE_AGE_S)


def _created(log: DataFrame, *also: Column) -> DataFrame:
    return log.groupBy("session_key").agg(F.date_trunc("day", F.min("ts")).cast(log.schema["ts"].dataType).alias("created_at"), *also)


def _session_history(spark, sf):
    log = view(spark, sf, "fx_lifecycle")
    return lifecycle.session_history(log, _created(log), keep=_keep("changes"))


def _stored_history(spark, sf):
    log = view(spark, sf, "fx_lifecycle")
    return stored(lifecycle.session_history(log, _created(log)), "history")


def _keep(label: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: stored(df, label)


def _launch_timeouts(spark, sf):
    log = view(spark, sf, "fx_launch_events")

    def kind(name):
        return log.where(F.col("kind") == name)

    return lifecycle.launch_timeouts(
        kind("launch").withColumnRenamed("event_id", "launch_id"),
        kind("callback"),
        kind("exit_nonzero"),
        TIMEOUT_S,
        LAUNCHES_UNTIL,
    )


def _idle_sessions(spark, sf):
    return lifecycle.idle_sessions(view(spark, sf, "fx_activity"), TIMEOUT_S, ACTIVITY_UNTIL)


def _grpc_requests(spark, sf):
    """gRPC rows with the session their token belongs to: none for the tokens made up as unknown."""
    unknown = F.col("req_id") % 10 == 4
    return (
        view(spark, sf, "fx_requests")
        .where(is_grpc(F.col("path")))
        .withColumn("session_key", F.when(~unknown, F.col("session_key")))
    )


def _resolve_requests(spark, sf):
    history = _stored_history(spark, sf)
    return resolution.resolve_requests(_grpc_requests(spark, sf), history, keep=_keep("asked"))


def _resolve_against_snapshot(spark, sf):
    requests = view(spark, sf, "fx_requests").where(is_grpc(F.col("path")))
    sessions = resolution.one_session_per_token(view(spark, sf, "fx_registry"))
    return resolution.resolve_against_snapshot(requests, sessions)


def _invalidations(spark, sf):
    return view(spark, sf, "fx_lifecycle").where(F.col("kind").isin(S.UNREGISTER, S.STOP)).select("session_key", "ts")


def _resolve_cached(spark, sf):
    history = _stored_history(spark, sf)
    return resolution.resolve_cached_requests(_grpc_requests(spark, sf), history, _invalidations(spark, sf), keep=_keep("asked"))


def _resolve_connects(spark, sf):
    resolved = stored(_resolve_requests(spark, sf), "resolved")
    return resolution.with_connect_failures(resolved, resolution.connect_runs(view(spark, sf, "fx_connects")))


def _request_outcomes(spark, sf):
    return resolution.request_outcomes(_resolve_requests(spark, sf))


def _upstream_reuse(spark, sf):
    valid = _grpc_requests(spark, sf).where(has_grpc_token(F.col("auth_header")))
    log = view(spark, sf, "fx_lifecycle")
    return traffic.upstream_reuse(valid, log.where(F.col("kind").isin(S.UNREGISTER, S.STOP)), _created(log))


def _launches(spark, sf):
    return view(spark, sf, "fx_launches").withColumn("packaged", F.col("session_id") % 5 == 0)


def _resolve_versions(spark, sf):
    return launch.resolve_versions(view(spark, sf, "fx_launches"), view(spark, sf, "fx_versions"))


def _configured(operator, spark, sf):
    names = ("fx_user_conf", "fx_conf_layers", "fx_versions")
    return operator(_launches(spark, sf), *(view(spark, sf, name) for name in names), SERVICE)


def _effective_config(spark, sf):
    return _configured(launch.effective_config, spark, sf)


def _violations(spark, sf):
    return launch.config_policy_violations(view(spark, sf, "fx_user_conf"))


def _launch_specs(spark, sf):
    return _configured(launch.launch_specs, spark, sf).withColumn("args", F.array_join("args", " "))


def _stream_registry(spark, sf):
    return upsert_to_files(streaming.stream_registry(view_stream(spark, sf, "fx_lifecycle")), "session_key", "registry")


def _stream_launch_timeouts(spark, sf):
    """All that the stream reports, and what it would report next if nothing came any more."""

    def kinds(rows, *names):
        return rows.where(F.col("kind").isin(*names))

    def inputs(rows):
        return kinds(rows, "launch").withColumnRenamed("event_id", "launch_id"), kinds(rows, "callback", "exit_nonzero")

    stream = streaming.stream_launch_timeouts(*inputs(view_stream(spark, sf, "fx_launch_events")), TIMEOUT_S, DELAY)
    reported, mark = append_to_files(stream, "launch-timeouts")
    rest = streaming.open_launch_timeouts(reported, *inputs(with_zone(view(spark, sf, "fx_launch_events"))), TIMEOUT_S, mark)
    return without_zone(reported.unionByName(rest))


def _stream_idle_sessions(spark, sf):
    """All spans the stream has closed, and those still open at its end."""
    reported, _ = append_to_files(streaming.stream_idle_sessions(view_stream(spark, sf, "fx_activity"), TIMEOUT_S, DELAY), "idle-sessions")
    rest = streaming.open_idle_sessions(reported, with_zone(view(spark, sf, "fx_activity")), TIMEOUT_S)
    return without_zone(reported.unionByName(rest))


def _stream_idle_stops(spark, sf):
    """Every session with its stop: from the stream where its watermark has passed all that could have kept it, else from the batch rule."""
    timer = idle_timer.stream_idle_stops(view_stream(spark, sf, "fx_activity"), TIMEOUT_S, DELAY)
    reported, _ = append_to_files(timer, "idle-stops", keyed_state=True)
    rest = idle_timer.open_idle_stops(reported, with_zone(view(spark, sf, "fx_activity")), TIMEOUT_S, ACTIVITY_UNTIL)
    return without_zone(reported.unionByName(rest))


def _launch_timer_net(spark, sf):
    """What three slices of the log, in order of arrival, have said of each launch in the end."""
    log = view(spark, sf, "fx_launch_events").withColumnRenamed("event_id", "launch_id")
    timer = LaunchTimer(spark, new_folder(spark, "launch-timer"), TIMEOUT_S, "timestamp_ntz", buckets=8)
    last = log.agg(F.max("launch_id")).first()[0] or 0
    edges = [-1, last // 3, last // 2, last]
    for a, b in zip(edges, edges[1:]):
        timer.take(log.where((F.col("launch_id") > a) & (F.col("launch_id") <= b)))
    return timer.net()


def _registry_store(spark, sf):
    store = RegistryStore(spark, new_folder(spark, "registry-store"))
    store.replace(with_zone(view(spark, sf, "fx_registry")))
    return store


def _registry_store_lookup(spark, sf):
    """Sessions by token, from their buckets of a stored registry."""
    tokens = [hashlib.md5(f"tok-{i}".encode()).hexdigest() for i in (1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 35, -1)]
    return without_zone(_registry_store(spark, sf).of_tokens(tokens))


def _registry_store_update(spark, sf):
    """A stored registry after a batch of events, of which only the touched buckets were rewritten."""
    store = _registry_store(spark, sf)
    store.update(event_batch.apply_events(store.read(), view(spark, sf, "fx_mixed_events")).touched)
    return without_zone(store.read())


def _incremental_session_history(spark, sf):
    """The history kept up to date over three slices of the log."""
    log = view(spark, sf, "fx_lifecycle")
    made = _created(log, F.min("seq").alias("_first")).where("session_key IS NOT NULL")
    made = stored(made, "created")  # each slice reads it several times
    store = HistoryStore(spark, new_folder(spark, "history"), "timestamp_ntz", buckets=16)
    last = log.agg(F.max("seq")).first()[0] or 0
    edges = [-1, last // 3, last // 2, last]
    for a, b in zip(edges, edges[1:]):
        slice_of = lambda column: (F.col(column) > a) & (F.col(column) <= b)
        store.add(log.where(slice_of("seq")), made.where(slice_of("_first")).drop("_first"))
    return store.read()


def _stream_request_resolution(spark, sf):
    requests = view_stream(spark, sf, "fx_requests").where(is_grpc(F.col("path")))
    sessions = resolution.one_session_per_token(view(spark, sf, "fx_registry"))
    resolved = streaming.stream_request_resolution(requests, sessions)
    return append_to_files(resolved, "request-resolution")[0]


def _requests(operator) -> Query:
    return lambda spark, sf: operator(view(spark, sf, "fx_requests"))


QUERIES: dict[str, Query] = {
    "list_sessions": _list_sessions,
    "lookup_sessions": _lookup_sessions,
    "register_sessions": _register_sessions,
    "apply_registrations": lambda spark, sf: _registrations(spark, sf).registry,
    "apply_registrations_unmatched": lambda spark, sf: _registrations(spark, sf).unmatched,
    "apply_unregistrations": lambda spark, sf: _unregistrations(spark, sf).registry,
    "apply_unregistrations_unmatched": lambda spark, sf: _unregistrations(spark, sf).unmatched,
    "apply_stops": lambda spark, sf: _stops(spark, sf).registry,
    "apply_stops_unmatched": lambda spark, sf: _stops(spark, sf).unmatched,
    "apply_stops_to_signal": lambda spark, sf: _stops(spark, sf).to_signal,
    "apply_launch_failures": lambda spark, sf: _launch_failures(spark, sf).registry,
    "apply_spawn_failures": lambda spark, sf: _launch_failures(spark, sf, guarded=False).registry,
    "parse_callbacks": _callbacks,
    "update_counts": _update_counts,
    "apply_connect_failures": lambda spark, sf: _connect_failures(spark, sf).registry,
    "apply_events": lambda spark, sf: _event_batch(event_batch.apply_events, spark, sf).registry,
    "apply_events_touched": lambda spark, sf: _event_batch(event_batch.apply_events, spark, sf).touched,
    "event_effects": lambda spark, sf: _event_batch(event_batch.event_effects, spark, sf),
    "event_effect_counts": lambda spark, sf: event_batch.effect_counts(_event_batch(event_batch.event_effects, spark, sf)),
    "prune_terminal": lambda spark, sf: _prune(spark, sf).pruned,
    "prune_terminal_kept": lambda spark, sf: _prune(spark, sf).kept,
    "health_sweep": lambda spark, sf: _health(spark, sf).registry,
    "health_sweep_failed": lambda spark, sf: _health(spark, sf).touched,
    "fold_lifecycle": lambda spark, sf: lifecycle.fold_lifecycle(view(spark, sf, "fx_lifecycle")),
    "session_history": _session_history,
    "incremental_session_history": _incremental_session_history,
    "registry_store_lookup": _registry_store_lookup,
    "registry_store_update": _registry_store_update,
    "launch_timeouts": _launch_timeouts,
    "launch_timer_net": _launch_timer_net,
    "idle_sessions": _idle_sessions,
    "traffic_by_route": _requests(traffic.traffic_by_route),
    "auth_header_audit": _requests(traffic.auth_header_audit),
    "resolve_identity": lambda spark, sf: traffic.resolve_identity(view(spark, sf, "fx_auth_attempts")),
    "resolve_requests": _resolve_requests,
    "resolve_against_snapshot": _resolve_against_snapshot,
    "request_outcomes": _request_outcomes,
    "resolve_cached_requests": _resolve_cached,
    "connect_runs": lambda spark, sf: resolution.connect_runs(view(spark, sf, "fx_connects")),
    "resolve_with_connects": _resolve_connects,
    "request_outcomes_with_connects": lambda spark, sf: resolution.request_outcomes(_resolve_connects(spark, sf)),
    "upstream_reuse": _upstream_reuse,
    "token_mismatches": _requests(traffic.token_mismatches),
    "control_traffic": _requests(traffic.control_traffic),
    "resolve_versions": _resolve_versions,
    "effective_config": _effective_config,
    "config_policy_violations": _violations,
    "launch_specs": _launch_specs,
    "stream_registry": _stream_registry,
    "stream_launch_timeouts": _stream_launch_timeouts,
    "stream_idle_sessions": _stream_idle_sessions,
    "stream_idle_stops": _stream_idle_stops,
    "stream_request_resolution": _stream_request_resolution,
}
