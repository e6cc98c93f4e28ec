"""Input views over the test tables. All but one text run unchanged on Spark and DuckDB.

``{orders}``, ``{events}`` and ``{lineitem}`` stand for the tables, ``{three}`` and ``{four}`` for a table t(m) of 1 to 3 or 4.
Stop requests cover all orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.sources.logs import stream_log

TABLES = ("orders", "events", "lineitem")

VIEWS = {
    "fx_registry": """
SELECT o_orderkey AS id, o_orderdate AS created_at,
  concat('user-', CAST(o_custkey AS STRING)) AS username,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('session ', CAST(o_orderkey AS STRING)) END AS name,
  CASE WHEN o_orderstatus = 'P' THEN 'LAUNCHING' WHEN o_orderstatus = 'O' THEN 'RUNNING'
       WHEN o_orderkey % 2 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS state,
  md5(concat('tok-', CAST(o_orderkey AS STRING))) AS token,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 10 <> 0
       THEN concat('10.0.0.', CAST(o_orderkey % 250 AS STRING), ':', CAST(15000 + o_orderkey % 1000 AS STRING)) END AS address,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 17 = 0 THEN ''
       ELSE concat('application_', CAST(o_orderkey AS STRING)) END AS application_id
FROM {orders}""",
    "fx_lifecycle": """
SELECT event_id AS seq, ts, user_id * 100 + CAST(extract(day FROM ts) AS BIGINT) AS session_key,
  CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'unregister' WHEN 'click' THEN 'stop'
       WHEN 'view' THEN 'connect_failed'
       ELSE CASE WHEN event_id % 2 = 0 THEN 'launch_failed' ELSE 'health_failed' END END AS kind,
  CASE WHEN event_type = 'signup' THEN concat('10.1.0.', CAST(event_id % 250 AS STRING), ':15002') END AS address,
  CASE WHEN event_type = 'signup' THEN concat('application_', CAST(event_id AS STRING)) END AS application_id
FROM {events}""",
    "fx_requests": """
SELECT event_id AS req_id, ts - INTERVAL '30' MINUTE AS ts, user_id * 100 + CAST(extract(day FROM ts) AS BIGINT) AS session_key,
  CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'GET' ELSE 'POST' END AS method,
  CASE event_type WHEN 'click' THEN '/spark.connect.SparkConnectService/ExecutePlan'
       WHEN 'purchase' THEN '/spark.connect.SparkConnectService/Config'
       WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN '/apps' WHEN event_id % 2 = 0 THEN '/apps?state=RUNNING' ELSE '/callback?' END
       WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN '/versions' WHEN event_id % 5 = 0 THEN concat('/apps/', CAST(event_id AS STRING), '?x=/1')
         ELSE concat('/apps/', CAST(event_id AS STRING)) END
       ELSE CASE WHEN event_id % 2 = 0 THEN '/callback' ELSE '/nope' END END AS path,
  CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'Basic abc123' WHEN 2 THEN 'Bearer ' WHEN 3 THEN 'Bearer'
       WHEN 4 THEN concat('Bearer ', md5(concat('unknown-', CAST(event_id AS STRING))))
       ELSE concat('Bearer ', md5(concat('tok-', CAST(event_id % 500 AS STRING)))) END AS auth_header,
  md5(concat('tok-', CAST(CASE WHEN event_id % 7 = 0 THEN event_id % 500 + 1 ELSE event_id % 500 END AS STRING))) AS conn_token,
  CASE event_id % 11 WHEN 0 THEN 'health' WHEN 1 THEN 'stop' WHEN 2 THEN 'bogus' END AS control
FROM {events}""",
    "fx_user_conf": """
SELECT l_orderkey AS session_id,
  CASE l_linenumber WHEN 1 THEN 'spark.files' WHEN 2 THEN 'spark.archives' WHEN 3 THEN 'spark.submit.pyFiles'
       WHEN 4 THEN 'spark.app.name' WHEN 5 THEN 'spark.jars.packages' WHEN 6 THEN 'spark.extraListeners'
       ELSE 'spark.executor.memory' END AS conf_key,
  CASE min(l_partkey) % 6 WHEN 0 THEN 's3://b/f.zip' WHEN 1 THEN 'hdfs://n/f, /local/x' WHEN 2 THEN 'file:///etc/p'
       WHEN 3 THEN '' WHEN 4 THEN ' s3://a , ,hdfs://b' ELSE 'plain' END AS conf_value
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "fx_versions": """
SELECT * FROM (VALUES (0, '4.0.0', '/opt/spark4', 'yarn', 'cluster', true), (1, '3.5.6', '/opt/spark3', 'yarn', 'cluster', false),
  (2, 'local', '/opt/spark4', CAST(NULL AS STRING), CAST(NULL AS STRING), false)) AS t(ord, version, home, master, deploy_mode, proxy_user)""",
    "fx_conf_layers": """
SELECT * FROM (VALUES ('4.0.0', 'default', 'spark.executor.memory', '2g'), ('4.0.0', 'default', 'spark.app.name', 'from-default'),
  ('4.0.0', 'merge', 'spark.jars.packages', 'g:delta:4'), ('4.0.0', 'override', 'spark.listeners', 'audit.L'),
  ('3.5.6', 'default', 'spark.jars.packages', 'g:base:3'), ('3.5.6', 'merge', 'spark.jars.packages', 'g:delta:3'),
  ('3.5.6', 'override', 'spark.executor.memory', '1g')) AS t(version, layer, conf_key, conf_value)""",
    "fx_launches": """
SELECT o_orderkey AS session_id, o_orderdate AS launched_at, concat('user-', CAST(o_custkey AS STRING)) AS username,
  CASE o_orderpriority WHEN '1-URGENT' THEN '4.0.0' WHEN '2-HIGH' THEN '3.5.6' WHEN '3-MEDIUM' THEN 'local'
       WHEN '4-NOT SPECIFIED' THEN 'no-such' END AS version_name,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('session ', CAST(o_orderkey AS STRING)) END AS app_name,
  md5(concat('tok-', CAST(o_orderkey AS STRING))) AS token
FROM {orders}""",
    "fx_probes": """
SELECT l_orderkey AS id, l_linenumber AS attempt, bool_or(l_returnflag = 'R') AS ok
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "fx_activity": """
SELECT user_id AS session_key, ts AS start_ts,
  CASE WHEN event_type = 'view' THEN ts + CAST(floor(value * 60) AS INT) * INTERVAL '1' SECOND ELSE ts END AS end_ts,
  CASE event_id % 11 WHEN 0 THEN 'health' WHEN 1 THEN 'stop' WHEN 2 THEN 'bogus' END AS control
FROM {events}""",
    "fx_launch_events": """
SELECT user_id AS session_key, event_id, ts, CASE event_type WHEN 'signup' THEN 'launch' WHEN 'view' THEN 'callback' ELSE 'exit_nonzero' END AS kind
FROM {events} WHERE event_type IN ('signup', 'view', 'error')""",
    "fx_auth_attempts": """
SELECT event_id AS req_id, m AS method_ord,
  CASE WHEN (event_id + m) % 4 = 0 THEN concat('user-', CAST(user_id AS STRING), '-m', CAST(m AS STRING)) END AS username,
  CASE WHEN (event_id + m) % 4 = 1 THEN 'InvalidToken' END AS error
FROM {events} {three}""",
    "fx_token_events": """
SELECT event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'unregister' WHEN 'error' THEN 'launch_failed'
       ELSE 'other' END AS kind,
  (user_id * 100 + CAST(extract(day FROM ts) AS BIGINT)) * 2 AS id,
  md5(concat('tok-', CAST((user_id * 100 + CAST(extract(day FROM ts) AS BIGINT)) * 2 AS STRING))) AS token,
  CASE WHEN event_type = 'signup' THEN concat('10.1.0.', CAST(event_id % 250 AS STRING), ':15002') END AS address,
  CASE WHEN event_type = 'signup' THEN concat('application_', CAST(event_id AS STRING)) END AS application_id
FROM {events}""",
    "fx_mixed_events": """
SELECT seq, kind, CASE WHEN kind IN ('register', 'unregister', 'connect_failed') THEN md5(concat('tok-', CAST(session AS STRING))) END AS token,
  CASE WHEN kind NOT IN ('register', 'unregister', 'connect_failed') THEN session END AS id,
  CASE WHEN kind <> 'stop' THEN NULL WHEN seq % 5 = 0 THEN 'user-none' ELSE concat('user-', CAST(o_custkey AS STRING)) END AS username,
  CASE WHEN kind = 'register' THEN concat('10.1.0.', CAST(seq % 250 AS STRING), ':15002') END AS address,
  CASE WHEN kind = 'register' THEN concat('application_', CAST(seq AS STRING)) END AS application_id
FROM (
  SELECT event_id AS seq, (user_id * 7 + event_id % 3) * (CASE WHEN event_id % 40 = 0 THEN -1 ELSE 1 END) AS session,
    CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'unregister' WHEN 'click' THEN 'stop'
         WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'connect_failed' ELSE 'health_failed' END ELSE 'launch_failed' END AS kind
  FROM {events}) e LEFT JOIN {orders} ON o_orderkey = session""",
    "fx_connects": """
SELECT user_id * 100 + CAST(extract(day FROM ts) AS BIGINT) AS session_key, ts - INTERVAL '30' MINUTE + (m - 1) * INTERVAL '1' SECOND AS ts, m AS attempt,
  CASE event_id % 6 WHEN 0 THEN FALSE WHEN 1 THEN m = 3 ELSE m = 1 END AS ok
FROM {events} {four}
WHERE event_type IN ('click', 'purchase') AND m <= CASE event_id % 6 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END""",
    "fx_stops": """
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'user-none' ELSE concat('user-', CAST(o_custkey AS STRING)) END AS username,
  CASE WHEN o_orderkey % 35 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS id
FROM {orders}""",
}


_schemas: dict[str, StructType] = {}


def _schema(spark: SparkSession, path: str) -> StructType:
    """The stored schema, read once per path."""
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return _schemas[path]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input view in batch."""

    def table(name: str) -> DataFrame:
        path = f"{sf_dir}/{name}.parquet"
        return spark.read.schema(_schema(spark, path)).parquet(path)

    return _over(spark, name, table)


def view_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input view as a stream, with its timestamps as watermarks need them."""

    def table(name: str) -> DataFrame:
        return stream_log(spark, sf_dir, _schema(spark, f"{sf_dir}/{name}.parquet"), only=f"{name}.parquet")

    return with_zone(_over(spark, name, table))


def with_zone(df: DataFrame) -> DataFrame:
    """TIMESTAMP_NTZ columns as TIMESTAMP."""
    return df.select(*[F.col(c).cast("timestamp_ltz").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def without_zone(df: DataFrame) -> DataFrame:
    """TIMESTAMP columns as TIMESTAMP_NTZ, to compare with plain SQL timestamps."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


_COUNTS = {
    "three": ("LATERAL VIEW explode(array(1, 2, 3)) t AS m", "CROSS JOIN (VALUES (1), (2), (3)) AS t(m)"),
    "four": ("LATERAL VIEW explode(array(1, 2, 3, 4)) t AS m", "CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(m)"),
}


def _over(spark: SparkSession, name: str, table) -> DataFrame:
    text = VIEWS[name]
    for word, (in_spark, _) in _COUNTS.items():
        text = text.replace("{" + word + "}", in_spark)
    return spark.sql(text, **{t: table(t) for t in TABLES if "{" + t + "}" in text})


def view_sql(name: str) -> str:
    counts = {word: in_sql for word, (_, in_sql) in _COUNTS.items()}
    return VIEWS[name].format(**counts, **{t: t for t in TABLES})
