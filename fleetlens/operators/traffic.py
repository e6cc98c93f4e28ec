"""Reports over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.clock import micros
from fleetlens.functions.headers import (
    callback_header_outcome,
    grpc_header_outcome,
    grpc_token,
    user_header_outcome,
)
from fleetlens.functions.routes import USER_ROUTES, is_grpc, route_of
from fleetlens.plans.cells import CELL, TIME_CELL, carry, cell_of, within


def traffic_by_route(requests: DataFrame) -> DataFrame:
    """Requests per route and method."""
    return (
        requests.select("method", route_of(F.col("method"), F.col("path")).alias("route"))
        .groupBy("route", "method")
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def auth_header_audit(requests: DataFrame) -> DataFrame:
    """Header outcomes per surface; requests no route serves aren't checked."""
    route, header = F.col("_route"), F.col("auth_header")
    surface = (
        F.when(route == "grpc", "grpc")
        .when(route == "callback", "callback")
        .when(route.isin(*USER_ROUTES), "user")
        .otherwise("none")
    )
    outcome = (
        F.when(F.col("surface") == "grpc", grpc_header_outcome(header))
        .when(F.col("surface") == "callback", callback_header_outcome(header))
        .when(F.col("surface") == "user", user_header_outcome(header))
        .otherwise("not_checked")
    )
    return (
        requests.select("auth_header", route_of(F.col("method"), F.col("path")).alias("_route"))
        .withColumn("surface", surface)
        .withColumn("outcome", outcome)
        .groupBy("surface", "outcome")
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def resolve_identity(attempts: DataFrame) -> DataFrame:
    """First method in order that yields a user, per request, and how many methods failed before it.

    ``attempts(req_id, method_ord, username, error)``, one row per request and method. One aggregation: it keeps the winner and how
    many errors there are, and the errors before the winner are counted in a second pass over the request's rows, of
    which only those with an error are left.
    """
    named = F.when(F.col("username").isNotNull(), F.col("method_ord"))
    winner = attempts.groupBy("req_id").agg(F.min_by("username", named).alias("username"), F.min(named).alias("method_ord"))
    failed = attempts.where(F.col("error").isNotNull()).select("req_id", F.col("method_ord").alias("_failed"))
    before = F.col("_failed").isNotNull() & (F.col("method_ord").isNull() | (F.col("_failed") < F.col("method_ord")))
    return (
        winner.join(failed, "req_id", "left")
        .groupBy("req_id", "username", "method_ord")
        .agg(F.count_if(before).alias("errors_before"))
        .select("req_id", "username", "method_ord", "errors_before", F.when(F.col("username").isNull(), 401).otherwise(200).alias("status"))
    )


def token_mismatches(requests: DataFrame) -> DataFrame:
    """gRPC requests whose own token isn't the connection's, with the first 8 characters of both."""
    return (
        requests.where(is_grpc(F.col("path")))
        .withColumn("_token", grpc_token(F.col("auth_header")))
        .where(F.col("_token") != F.col("conn_token"))
        .select(
            "req_id",
            "ts",
            F.substring("conn_token", 1, 8).alias("conn_prefix"),
            F.substring("_token", 1, 8).alias("token_prefix"),
        )
    )


def control_traffic(requests: DataFrame) -> DataFrame:
    """Control messages by what the session answers; gRPC requests without one are normal traffic.

    Only a session's gRPC interceptor reads the control value, so other requests don't count.
    """
    control = F.col("control")
    return (
        requests.where(is_grpc(F.col("path"))).select(
            F.when(control.isNull(), "NORMAL")
            .when(control == "health", "OK")
            .when(control == "stop", "CANCELLED")
            .otherwise("INVALID_ARGUMENT")
            .alias("answer"),
        )
        .groupBy("answer")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            "answer",
            (F.col("answer") == "NORMAL").alias("is_activity"),
            (F.col("answer") == "CANCELLED").alias("shuts_down"),
            "requests",
        )
    )


def mark_reuse(requests: DataFrame, invalidations: DataFrame, created: DataFrame, width: int = TIME_CELL) -> DataFrame:
    """Requests of known sessions with ``cached``: false for the first after the start or an invalidation.

    ``requests(session_key, req_id, ts)``, ``invalidations(session_key, ts)``, ``created(session_key, created_at)``. A request
    before its session's creation finds none, so it neither opens nor reuses a connection. A request opens one
    exactly when the event before it is an invalidation or nothing, so only the last event's kind crosses a cell's border.
    """
    key = "session_key"
    no_id = F.lit(None).cast(requests.schema["req_id"].dataType).alias("req_id")
    served = requests.where(F.col(key).isNotNull()).select(key, "req_id", "ts").join(created.select(key, "created_at"), key)
    log = (
        served.where(F.col("created_at") <= F.col("ts"))
        .select(key, "req_id", "ts", F.lit(1).alias("_what"))
        .unionByName(invalidations.select(key, no_id, "ts", F.lit(0).alias("_what")))
        .withColumn("_at", micros(F.col("ts")))
        .withColumn(CELL, cell_of(F.col("_at"), width))
    )
    carried = (
        log.groupBy(key, CELL)
        .agg(F.expr("max(struct(_at, _what)) AS _newest"))
        .select(key, CELL, F.lag("_newest._what").over(Window.partitionBy(key).orderBy(CELL)).alias("_before"))
    )
    previous = F.coalesce(F.lag("_what").over(within(key, "_at", "_what", "req_id")), F.col("_before"), F.lit(0))
    return carry(log, carried, key).withColumn("cached", previous == 1).where("_what = 1").select(key, "req_id", "ts", "cached")


def upstream_reuse(requests: DataFrame, invalidations: DataFrame, created: DataFrame, width: int = TIME_CELL) -> DataFrame:
    """Connections opened (misses) and reused (hits) per session."""
    return (
        mark_reuse(requests, invalidations, created, width)
        .groupBy("session_key")
        .agg(F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"))
    )
