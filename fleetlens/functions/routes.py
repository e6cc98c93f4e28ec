"""Sorting requests by the route that serves them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The gRPC path prefix and the REST routes.
GRPC_PREFIX = "/spark.connect.SparkConnectService"
APPS, VERSIONS, CALLBACK = "/apps", "/versions", "/callback"
_ONE_APP = r"^/apps/[^/]+\z"
_INTEGER = r"^[+-]?[0-9]+\z"

USER_ROUTES = ("apps", "app", "versions", "rest_bad_id")


def is_grpc(path: Column) -> Column:
    return path.startswith(GRPC_PREFIX)


def route_of(method: Column, path: Column) -> Column:
    """grpc, apps, app, versions, callback, rest_bad_id, method_not_allowed or not_found. HEAD counts as GET.

    Only what stands before a ``?`` chooses the route.
    """
    path = F.substring_index(path, "?", 1)
    reads = method.isin("GET", "HEAD")
    app_id = F.substring(path, F.lit(len("/apps/") + 1), F.length(path))
    int32 = app_id.rlike(_INTEGER) & app_id.try_cast("int").isNotNull()

    def allowed(condition: Column, route: str | Column) -> Column:
        return F.when(condition, route).otherwise("method_not_allowed")

    return (
        F.when(is_grpc(path), "grpc")
        .when(path == APPS, allowed(reads | (method == "POST"), "apps"))
        .when(
            path.rlike(_ONE_APP),
            allowed(reads | (method == "DELETE"), F.when(int32, "app").otherwise("rest_bad_id")),
        )
        .when(path == VERSIONS, allowed(reads, "versions"))
        .when(path == CALLBACK, allowed(method.isin("POST", "DELETE"), "callback"))
        .otherwise("not_found")
    )
