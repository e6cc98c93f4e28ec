"""Schemas and fixed domains shared by the operators."""

from pyspark.sql import types as T

# The four session states, upper case, compared case-sensitively.
LAUNCHING = "LAUNCHING"
RUNNING = "RUNNING"
FAILED = "FAILED"
FINISHED = "FINISHED"
STATES = (LAUNCHING, RUNNING, FAILED, FINISHED)
TERMINAL_STATES = (FAILED, FINISHED)

# Lifecycle event kinds. The unguarded ones apply whatever the old state was;
# the guarded ones apply only to the state given with them.
CREATE = "create"
REGISTER = "register"
UNREGISTER = "unregister"
STOP = "stop"
CONNECT_FAILED = "connect_failed"
UNGUARDED_KINDS = (REGISTER, UNREGISTER, STOP, CONNECT_FAILED)
LAUNCH_FAILED = "launch_failed"  # only while LAUNCHING
HEALTH_FAILED = "health_failed"  # only while RUNNING

# First try plus three retries, for connects and for health probes alike.
MAX_ATTEMPTS = 4

# Default timeouts and the idle poll, in seconds.
LAUNCH_TIMEOUT_S = 300
IDLE_TIMEOUT_S = 3600
IDLE_POLL_S = 60

# gRPC status by request outcome. Requests still waiting have no answer yet.
OUTCOME_CODES = (
    ("ok", 0),
    ("unauthenticated", 16),
    ("token_mismatch", 16),
    ("authorization_error", 16),
    ("not_found", 5),
    ("no_address", 14),
    ("launching", 14),
    ("upstream_connect", 14),
    ("upstream_handshake", 14),
    ("upstream_request", 14),
    ("bad_state", 9),
    ("database", 13),
    ("bad_upstream_uri", 13),
    ("internal", 13),
    ("waiting", None),
    ("pending", None),
)

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("username", T.StringType(), False),
        T.StructField("name", T.StringType(), True),
        T.StructField("state", T.StringType(), False),
        T.StructField("token", T.StringType(), False),
        T.StructField("address", T.StringType(), True),
        T.StructField("application_id", T.StringType(), True),
    ]
)
REGISTRY_COLUMNS = REGISTRY_SCHEMA.fieldNames()

LIFECYCLE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("session_key", T.LongType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("address", T.StringType(), True),
        T.StructField("application_id", T.StringType(), True),
    ]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("req_id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("session_key", T.LongType(), True),
        T.StructField("method", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("auth_header", T.StringType(), True),
        T.StructField("conn_token", T.StringType(), True),
        T.StructField("control", T.StringType(), True),
    ]
)

PROBE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("attempt", T.IntegerType(), False),
        T.StructField("ok", T.BooleanType(), False),
    ]
)
