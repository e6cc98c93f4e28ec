"""What a launch request turns into: its version, settings, policy findings and command line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.text import trim_whitespace

# Spark's own setting names that the launcher sets or checks.
APP_NAME = "spark.app.name"
TOKEN = "spark.connect.authenticate.token"
LISTENERS = "spark.extraListeners"
INTERCEPTORS = "spark.connect.grpc.interceptor.classes"
PORT = "spark.connect.grpc.binding.port"
ARCHIVES = "spark.archives"
PYTHON = "spark.sql.execution.pyspark.python"
ENVIRONMENT_PYTHON = "../environment/bin/python"
CHECKED_KEYS = ("spark.files", "spark.archives", "spark.submit.pyFiles")


@dataclass(frozen=True)
class Service:
    """The deployment's own values: key and class names of its driver plug-in, and where it listens."""

    callback: str
    idle_timeout_s: int
    tarball: str
    callback_key: str = "spark.fleet.callback"
    idle_key: str = "spark.fleet.idle.timeout"
    listener_class: str = "fleet.SessionListener"
    interceptor_class: str = "fleet.SessionInterceptor"
    main_class: str = "fleet.SessionServer"
    plugin: str = "/opt/fleet/plugin.jar"
    app_name_prefix: str = "fleet-session-"


def resolve_versions(launches: DataFrame, versions: DataFrame) -> DataFrame:
    """Launches with their catalogue row. No name means the first version; an unknown name is not found.

    The catalogue is a configuration list. Spark broadcasts it by its measured size.
    """
    columns = [c for c in versions.columns if c not in ("ord", "version")]
    packed = F.struct("version", *columns)
    by_name = versions.groupBy(F.col("version").alias("version_name")).agg(F.min_by(packed, "ord").alias("_v"))
    default = versions.agg(F.min_by(packed, "ord").alias("_v")).select(
        F.lit(None).cast("string").alias("version_name"), "_v"
    )
    catalogue = by_name.unionByName(default).withColumnRenamed("version_name", "_name")
    return (
        launches.join(catalogue, F.col("version_name").eqNullSafe(F.col("_name")), "left")
        .withColumn("version", F.col("_v.version"))
        .withColumn("version_status", F.when(F.col("_v").isNull(), "not_found").otherwise("found"))
        .select(*launches.columns, "version", "version_status", *[F.col(f"_v.{c}").alias(c) for c in columns])
    )


def list_versions(versions: DataFrame) -> DataFrame:
    """Names of the catalogue in its order; the first is the default."""
    return versions.orderBy("ord").select("version")


def _settings_by_version(versions: DataFrame, layers: DataFrame, service: Service) -> DataFrame:
    """Per (version, packaged), every key a launch gets whatever the user asks for, as a map to its layers.

    One aggregation over the configuration tables; the map grows with them, not with the launches.
    """
    always = [APP_NAME, TOKEN, service.callback_key, service.idle_key, LISTENERS, INTERCEPTORS, PORT]
    nothing = F.lit(None).cast("string")
    own = versions.select("version", F.explode(F.array(*[F.lit(k) for k in always])).alias("conf_key"), nothing.alias("layer"), nothing.alias("conf_value"))
    both = own.unionByName(layers.select("version", "conf_key", "layer", "conf_value")).withColumn("packaged", F.explode(F.array(F.lit(False), F.lit(True))))
    packed = versions.select(
        "version",
        F.explode(F.array(F.lit(ARCHIVES), F.lit(PYTHON))).alias("conf_key"),
        nothing.alias("layer"),
        nothing.alias("conf_value"),
        F.lit(True).alias("packaged"),
    )
    entries = both.unionByName(packed).groupBy("version", "packaged").agg(F.collect_list(F.struct("conf_key", "layer", "conf_value")).alias("_e"))
    keys = F.array_distinct(F.transform("_e", lambda e: e["conf_key"]))

    def of_layer(key: Column, name: str) -> Column:
        own = F.filter("_e", lambda e: (e["conf_key"] == key) & (e["layer"] == name))
        return F.array_max(F.transform(own, lambda e: e["conf_value"])).alias(name)

    by_key = F.transform(keys, lambda k: F.struct(*[of_layer(k, n) for n in ("default", "merge", "override")]))
    return entries.select("version", "packaged", F.map_from_arrays(keys, by_key).alias("_given"))


def _session_rows(launches: DataFrame, user_conf: DataFrame, given: DataFrame, versions: DataFrame) -> DataFrame:
    """Launches with a known version, one row for each setting the user asked for, at least one; ``_first`` is true on one row of a session.

    Both sides are shuffled and sorted once, by ``session_id``, and numbered before they meet, so that no launch is sorted once for each of its settings.
    ``_asked`` has the user's keys that any version gives.
    """
    session = Window.partitionBy("session_id")
    resolved = resolve_versions(launches, versions).where(F.col("version_status") == "found")
    resolved = resolved.select("session_id", "app_name", "token", "version", F.coalesce("packaged", F.lit(False)).alias("packaged"))
    resolved = resolved.withColumn("_launch", F.row_number().over(session.orderBy("session_id")))
    keys = given.select(F.explode(F.map_keys("_given")).alias("conf_key"), F.lit(True).alias("_known")).distinct()
    asked = user_conf.select("session_id", "conf_key", F.col("conf_value").alias("_user")).join(keys, "conf_key", "left")
    known = F.collect_set(F.when(F.col("_known"), F.col("conf_key"))).over(session)
    asked = asked.withColumns({"_setting": F.row_number().over(session.orderBy("conf_key")), "_asked": known}).drop("_known")
    first = (F.col("_launch") == 1) & (F.coalesce("_setting", F.lit(1)) == 1)
    return resolved.join(asked, "session_id", "left").withColumn("_first", first)


def _with_values(rows: DataFrame, given: DataFrame, service: Service) -> DataFrame:
    """A row per final setting (conf_key, conf_value) of each session; null ones where a session has none.

    The first row of a session also brings the keys its version gives that the user didn't ask for. The settings ``given`` by a version join the
    rows after the last sort: they are many times as long as a row.
    """
    none = F.array().cast("array<struct<key:string,user:string>>")
    own = F.when(F.col("conf_key").isNotNull(), F.array(F.struct(F.col("conf_key").alias("key"), F.col("_user").alias("user")))).otherwise(none)
    others = F.transform(
        F.array_except(F.map_keys("_given"), F.coalesce("_asked", F.array().cast("array<string>"))), lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("user"))
    )
    entries = F.concat(own, F.when(F.col("_first"), F.coalesce(others, none)).otherwise(none))
    rows = rows.join(given, ["version", "packaged"], "left").withColumn("_entry", F.explode_outer(entries))
    key = F.col("_entry.key")
    value = _value(key, F.element_at("_given", key), F.col("_entry.user"), service)
    return rows.drop("conf_key").withColumns({"conf_key": key, "conf_value": value})


def _value(key: Column, layer: Column, user: Column, service: Service) -> Column:
    """The final value of a setting, from the layers of its key and what the user asked for."""
    base = F.coalesce(user, layer["default"])
    merged = F.when(layer["merge"].isNotNull() & base.isNotNull(), F.concat(base, F.lit(","), layer["merge"])).otherwise(F.coalesce(layer["merge"], base))
    layered = F.coalesce(layer["override"], merged)
    environment = F.lit(f"{service.tarball}#environment")
    return (
        F.when(
            key == APP_NAME,
            F.coalesce("app_name", layered, F.concat(F.lit(service.app_name_prefix), F.col("session_id").cast("string"))),
        )
        .when(key == TOKEN, F.col("token"))
        .when(key == service.callback_key, service.callback)
        .when(key == service.idle_key, str(service.idle_timeout_s))
        .when(key == LISTENERS, service.listener_class)
        .when(key == INTERCEPTORS, service.interceptor_class)
        .when(key == PORT, "0")
        .when((key == PYTHON) & F.col("packaged"), ENVIRONMENT_PYTHON)
        .when(
            (key == ARCHIVES) & F.col("packaged"),
            F.when(F.length(layered) > 0, F.concat(layered, F.lit(","), environment)).otherwise(environment),
        )
        .otherwise(layered)
    )


def effective_config(
    launches: DataFrame, user_conf: DataFrame, layers: DataFrame, versions: DataFrame, service: Service
) -> DataFrame:
    """Final settings per launch in long form (session_id, conf_key, conf_value).

    ``launches(session_id, version_name, app_name, token, packaged)``; launches with an unknown version
    have no settings. ``user_conf(session_id, conf_key, conf_value)`` has one row per session and key. The settings of one
    session are worked on by one task, as they are one command line in the end.
    """
    given = _settings_by_version(versions, layers, service)
    return _with_values(_session_rows(launches, user_conf, given, versions), given, service).select("session_id", "conf_key", "conf_value")


def _findings(value: Column) -> Column:
    """Offending entries of a comma-separated list, as array<struct<pos, entry, reason>>."""
    entries = F.transform(
        F.split(value, ",", -1),
        lambda piece, at: F.struct(at.alias("pos"), trim_whitespace(piece).alias("entry")),
    )
    judged = F.transform(
        entries,
        lambda e: F.struct(
            e["pos"].alias("pos"),
            e["entry"].alias("entry"),
            F.when(e["entry"] == "", F.lit(None))
            .when(~e["entry"].contains("://"), "no_protocol")
            .when(e["entry"].startswith("file://"), "file_protocol")
            .alias("reason"),
        ),
    )
    return F.filter(judged, lambda e: e["reason"].isNotNull())


def _rank(key: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in CHECKED_KEYS]), key)


def config_policy_violations(user_conf: DataFrame) -> DataFrame:
    """Every entry of the file settings without a protocol or with file://; ``is_first`` is the one that rejects.

    The window that finds the first runs before the entries are exploded, over at most one row per
    checked key of a session.
    """
    rank = _rank(F.col("conf_key"))
    found = (
        user_conf.where(F.col("conf_key").isin(*CHECKED_KEYS))
        .select("session_id", "conf_key", rank.alias("_rank"), _findings(F.col("conf_value")).alias("_found"))
        .where(F.size("_found") > 0)
        .withColumn("_first_rank", F.min("_rank").over(Window.partitionBy("session_id")))
        .withColumn("_first_pos", F.col("_found")[0]["pos"])
    )
    return found.select("*", F.explode("_found").alias("_e")).select(
        "session_id",
        "conf_key",
        F.col("_e.pos").alias("pos"),
        F.col("_e.entry").alias("entry"),
        F.col("_e.reason").alias("reason"),
        ((F.col("_rank") == F.col("_first_rank")) & (F.col("_e.pos") == F.col("_first_pos"))).alias("is_first"),
    )


def launch_specs(
    launches: DataFrame, user_conf: DataFrame, layers: DataFrame, versions: DataFrame, service: Service
) -> DataFrame:
    """One row per launch: its submit command, or why it is rejected (version first, then policy).

    ``args`` is an array; settings are in key order. A launch's settings end up on one command
    line, so the operating system's argument limit bounds what is collected per row. The user's settings become one row of a session
    first, combined map-side, and meet its launch there; the settings of its version join that row, and all the rest are expressions on it.
    """
    entry = F.struct(F.col("conf_key"), F.col("conf_value"))
    asked = user_conf.where(F.col("conf_key").isNotNull()).groupBy("session_id").agg(F.collect_list(entry).alias("_asked"))
    resolved = resolve_versions(launches, versions).withColumn("packaged", F.coalesce("packaged", F.lit(False)))
    given = _settings_by_version(versions, layers, service)
    rows = resolved.join(asked, "session_id", "left").join(given, ["version", "packaged"], "left")
    nothing = F.array().cast("array<struct<conf_key:string,conf_value:string>>")
    rows = rows.withColumn("_asked", F.coalesce("_asked", nothing))
    checked = F.filter("_asked", lambda e: e["conf_key"].isin(*CHECKED_KEYS))
    found = F.transform(checked, lambda e: F.struct(_rank(e["conf_key"]).alias("rank"), _findings(e["conf_value"]).alias("found")))
    bad = F.filter(found, lambda f: F.size(f["found"]) > 0)
    policy = F.array_min(F.transform(bad, lambda f: F.struct(f["rank"].alias("rank"), f["found"][0]["pos"].alias("pos"), f["found"][0]["reason"].alias("reason"))))
    rejected = F.when(F.col("version_status") != "found", "version_not_found").otherwise(policy["reason"])
    keys = F.array_union(F.transform("_asked", lambda e: e["conf_key"]), F.coalesce(F.map_keys("_given"), F.array().cast("array<string>")))
    user = F.map_from_entries("_asked")
    settings = F.transform(
        F.col("_keys"),
        lambda k: F.struct(k.alias("conf_key"), _value(k, F.element_at("_given", k), F.element_at("_user", k), service).alias("conf_value")),
    )
    specs = rows.withColumns({"rejected_reason": rejected, "_keys": keys, "_user": user})
    specs = specs.withColumn("_conf", F.when(F.col("rejected_reason").isNull(), F.array_sort(settings)))
    accepted = F.col("rejected_reason").isNull()
    none = F.array().cast("array<string>")
    conf = F.flatten(
        F.transform(
            F.col("_conf"),
            lambda c: F.array(F.lit("--conf"), F.concat(c["conf_key"], F.lit("="), c["conf_value"])),
        )
    )

    def option(flag: str, value: Column, wanted: Column) -> Column:
        return F.when(wanted, F.array(F.lit(flag), value)).otherwise(none)

    args = F.concat(
        option("--master", F.col("master"), F.col("master").isNotNull()),
        option("--deploy-mode", F.col("deploy_mode"), F.col("deploy_mode").isNotNull()),
        F.coalesce(conf, none),
        F.array(F.lit("--class"), F.lit(service.main_class)),
        option("--proxy-user", F.col("username"), F.coalesce("proxy_user", F.lit(False))),
        F.array(F.lit(service.plugin)),
    )
    return specs.select(
        "session_id",
        F.when(accepted, "LAUNCHING").otherwise("FAILED").alias("state"),
        "rejected_reason",
        F.when(accepted, F.concat(F.col("home"), F.lit("/bin/spark-submit"))).alias("command"),
        F.when(accepted, args).alias("args"),
    )
