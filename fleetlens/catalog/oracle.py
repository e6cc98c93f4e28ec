"""The registered queries in plain SQL, written row by row where the Spark jobs work on aggregates."""

from __future__ import annotations

from fleetlens.catalog.fixtures import view_sql


def _sql(views: list[str], body: str) -> str:
    """``body`` with the input views in front; it is a SELECT or starts with more ``name AS (...),``."""
    heads = ",\n".join(f"{name} AS ({view_sql(name)})" for name in views)
    return f"WITH {heads}{',' if body.lstrip().startswith('--ctes') else ''}\n{body}"


_ALL = "id, created_at, username, name, state, token, address, application_id"


def _update(views: list[str], hits: str, on: str, state: str, address: str, app: str, guard: str = "TRUE") -> str:
    return _sql(
        ["fx_registry", *views],
        f"""--ctes
hits AS ({hits})
SELECT r.id, r.created_at, r.username, r.name,
  CASE WHEN h.hit AND {guard} THEN '{state}' ELSE r.state END AS state, r.token,
  CASE WHEN h.hit AND {guard} THEN {address} ELSE r.address END AS address,
  CASE WHEN h.hit AND {guard} THEN {app} ELSE r.application_id END AS application_id
FROM fx_registry r LEFT JOIN hits h ON {on}""",
    )


_LAST_REGISTER = """SELECT token, address, application_id, TRUE AS hit FROM (
  SELECT *, row_number() OVER (PARTITION BY token ORDER BY seq DESC) AS rn FROM fx_token_events WHERE kind = 'register')
WHERE rn = 1"""

_HEALTHY = "SELECT DISTINCT id FROM fx_probes WHERE attempt <= 4 AND ok"
_SICK = (
    "r.state = 'RUNNING' AND (r.address IS NULL OR NOT EXISTS (SELECT 1 FROM fx_probes p"
    " WHERE p.id = r.id AND p.attempt BETWEEN 1 AND 4 AND p.ok))"
)
_OLD = "state IN ('FAILED', 'FINISHED') AND created_at <= TIMESTAMP '2000-01-01 00:00:00'"

_UNGUARDED = "('register', 'unregister', 'stop', 'connect_failed')"

_HISTORY = f"""
log AS (
  SELECT session_key, seq, ts, kind, address, application_id FROM fx_lifecycle
  UNION ALL
  SELECT session_key, NULL, date_trunc('day', min(ts)), 'create', NULL, NULL FROM fx_lifecycle GROUP BY session_key),
guards AS (
  SELECT * REPLACE (max(ts) OVER (PARTITION BY session_key ORDER BY seq NULLS FIRST ROWS UNBOUNDED PRECEDING) AS ts),
    last_value(CASE WHEN kind IN {_UNGUARDED} THEN kind END IGNORE NULLS) OVER (
      PARTITION BY session_key ORDER BY seq NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS set_by,
    last_value(CASE WHEN kind = 'register' THEN application_id END IGNORE NULLS) OVER (
      PARTITION BY session_key ORDER BY seq NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS app
  FROM log),
statuses AS (
  SELECT session_key, seq, ts, app,
    CASE WHEN kind = 'create' THEN 'LAUNCHING' WHEN kind = 'register' THEN 'RUNNING'
         WHEN kind IN ('unregister', 'stop') THEN 'FINISHED' ELSE 'FAILED' END AS state,
    CASE WHEN kind = 'register' THEN address END AS address
  FROM guards
  WHERE NOT (kind = 'launch_failed' AND set_by IS NOT NULL)
    AND NOT (kind = 'health_failed' AND set_by IS DISTINCT FROM 'register')),
marked AS (
  SELECT *, row_number() OVER w AS nth, lag(state) OVER w AS state0, lag(address) OVER w AS address0, lag(app) OVER w AS app0
  FROM statuses WINDOW w AS (PARTITION BY session_key ORDER BY seq NULLS FIRST)),
history AS (
  SELECT session_key, seq, ts AS valid_from,
    lead(ts) OVER (PARTITION BY session_key ORDER BY seq NULLS FIRST) AS valid_to, state, address, app AS application_id
  FROM marked
  WHERE nth = 1 OR state IS DISTINCT FROM state0 OR address IS DISTINCT FROM address0 OR app IS DISTINCT FROM app0)"""

# Every event with the row it names, what was there before it, and what it did.
_EFFECTS = f"""
named AS (
  SELECT e.seq, e.kind, e.address AS new_address, e.application_id AS new_app, r.id, r.token, r.state AS state0, r.address AS address0, r.application_id AS app0
  FROM fx_mixed_events e LEFT JOIN fx_registry r ON CASE WHEN e.kind IN ('register', 'unregister', 'connect_failed') THEN r.token = e.token
    WHEN e.kind = 'stop' THEN r.id = e.id AND r.username = e.username ELSE r.id = e.id END),
before AS (
  SELECT *, last_value(CASE WHEN kind IN {_UNGUARDED} THEN kind END IGNORE NULLS) OVER earlier AS set_by,
    last_value(CASE WHEN kind IN {_UNGUARDED} THEN seq END IGNORE NULLS) OVER earlier AS set_at,
    last_value(CASE WHEN kind IN {_UNGUARDED} THEN coalesce(new_address, '-') END IGNORE NULLS) OVER earlier AS set_address,
    last_value(CASE WHEN kind = 'register' THEN new_app END IGNORE NULLS) OVER earlier AS app_before,
    max(CASE WHEN kind = 'health_failed' THEN seq END) OVER earlier AS health_at,
    bool_or(kind = 'launch_failed') OVER earlier AS failed_before
  FROM named WINDOW earlier AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
states AS (
  SELECT *, CASE WHEN id IS NULL THEN NULL WHEN set_by IS NULL THEN CASE WHEN state0 = 'LAUNCHING' AND failed_before OR state0 = 'RUNNING' AND health_at IS NOT NULL THEN 'FAILED' ELSE state0 END
      WHEN set_by = 'register' THEN CASE WHEN health_at > set_at THEN 'FAILED' ELSE 'RUNNING' END
      WHEN set_by = 'connect_failed' THEN 'FAILED' ELSE 'FINISHED' END AS state1,
    CASE WHEN id IS NULL THEN NULL WHEN set_by IS NULL THEN CASE WHEN state0 = 'RUNNING' AND health_at IS NOT NULL THEN NULL ELSE address0 END
      WHEN set_by = 'register' AND NOT coalesce(health_at > set_at, FALSE) THEN set_address END AS address1,
    CASE WHEN id IS NOT NULL THEN coalesce(app_before, app0) END AS app1
  FROM before),
effects AS (
  SELECT seq, kind, id, token, id IS NOT NULL AS matched,
    id IS NOT NULL AND (kind IN {_UNGUARDED} OR kind = 'launch_failed' AND state1 = 'LAUNCHING' OR kind = 'health_failed' AND state1 = 'RUNNING') AS effective,
    CASE WHEN kind = 'register' THEN 'RUNNING' WHEN kind IN ('unregister', 'stop') THEN 'FINISHED' ELSE 'FAILED' END AS state2,
    state1, address1, CASE WHEN id IS NULL THEN NULL WHEN kind = 'register' THEN new_app ELSE app1 END AS application_id, new_address
  FROM states),
judged AS (
  SELECT seq, kind, id, token, matched, effective, CASE WHEN effective THEN state2 ELSE state1 END AS state,
    CASE WHEN NOT effective OR kind = 'launch_failed' THEN address1 WHEN kind = 'register' THEN new_address END AS address, application_id,
    CASE WHEN kind = 'stop' THEN address1 END AS signal_address
  FROM effects),
ends AS (SELECT id, arg_max(j, seq) AS j, bool_or(effective) AS hit FROM judged j WHERE id IS NOT NULL GROUP BY id),
after AS (
  SELECT r.id, r.created_at, r.username, r.name, CASE WHEN e.id IS NULL THEN r.state ELSE e.j.state END AS state, r.token,
    CASE WHEN e.id IS NULL THEN r.address ELSE e.j.address END AS address,
    CASE WHEN e.id IS NULL THEN r.application_id ELSE e.j.application_id END AS application_id, coalesce(e.hit, FALSE) AS hit
  FROM fx_registry r LEFT JOIN ends e USING (id))"""

_EVENT_VIEWS = ["fx_registry", "fx_mixed_events"]

_FOLD = f"""SELECT session_key,
  CASE WHEN set_kind IS NULL THEN CASE WHEN lf THEN 'FAILED' ELSE 'LAUNCHING' END
       WHEN set_kind = 'register' THEN CASE WHEN coalesce(health, -1) > set_seq THEN 'FAILED' ELSE 'RUNNING' END
       WHEN set_kind IN ('unregister', 'stop') THEN 'FINISHED' ELSE 'FAILED' END AS state,
  CASE WHEN set_kind = 'register' AND coalesce(health, -1) <= set_seq THEN set_address END AS address,
  app AS application_id
FROM (
  SELECT session_key,
    arg_max(kind, seq) FILTER (WHERE kind IN {_UNGUARDED}) AS set_kind,
    max(seq) FILTER (WHERE kind IN {_UNGUARDED}) AS set_seq,
    arg_max(address, seq) FILTER (WHERE kind = 'register') AS set_address,
    max(seq) FILTER (WHERE kind = 'health_failed') AS health,
    bool_or(kind = 'launch_failed') AS lf,
    arg_max(application_id, seq) FILTER (WHERE kind = 'register') AS app
  FROM fx_lifecycle GROUP BY session_key)"""

_HEADER = """CASE WHEN auth_header IS NULL THEN 'missing' WHEN instr(auth_header, ' ') = 0 THEN 'invalid'
       WHEN substr(auth_header, 1, instr(auth_header, ' ') - 1) <> 'Bearer' THEN 'bad_scheme'
       WHEN length(auth_header) = 7 THEN 'invalid' ELSE 'ok' END"""
_TOKEN = f"CASE WHEN {_HEADER} = 'ok' THEN substr(auth_header, 8) END"
_GRPC = "starts_with(path, '/spark.connect.SparkConnectService')"

_PATH = "split_part(path, '?', 1)"
_ROUTE = f"""CASE WHEN {_GRPC} THEN 'grpc'
  WHEN {_PATH} = '/apps' THEN CASE WHEN method IN ('GET', 'HEAD', 'POST') THEN 'apps' ELSE 'method_not_allowed' END
  WHEN regexp_full_match({_PATH}, '/apps/[^/]+') THEN CASE WHEN method NOT IN ('GET', 'HEAD', 'DELETE') THEN 'method_not_allowed'
    WHEN regexp_full_match({_PATH}, '/apps/[+-]?[0-9]+') AND TRY_CAST(substr({_PATH}, 7) AS INTEGER) IS NOT NULL THEN 'app' ELSE 'rest_bad_id' END
  WHEN {_PATH} = '/versions' THEN CASE WHEN method IN ('GET', 'HEAD') THEN 'versions' ELSE 'method_not_allowed' END
  WHEN {_PATH} = '/callback' THEN CASE WHEN method IN ('POST', 'DELETE') THEN 'callback' ELSE 'method_not_allowed' END
  ELSE 'not_found' END"""

_RESOLVED = f"""{_HISTORY},
requests AS (
  SELECT req_id, ts, CASE WHEN req_id % 10 <> 4 THEN session_key END AS session_key, path, {_HEADER} AS header,
    {_TOKEN} AS token, conn_token FROM fx_requests WHERE {_GRPC}),
starts AS (SELECT session_key, valid_from AS created_at, valid_to AS launch_end FROM history WHERE state = 'LAUNCHING'),
placed AS (
  SELECT r.*, s.created_at, s.launch_end,
    CASE WHEN r.header <> 'ok' THEN 'unauthenticated' WHEN s.created_at IS NULL OR s.created_at > r.ts THEN 'not_found'
         WHEN r.token <> r.conn_token THEN 'token_mismatch' WHEN s.launch_end IS NULL THEN 'pending' END AS early,
    CASE WHEN s.launch_end > r.ts
         THEN r.ts + to_seconds(CAST(ceil((epoch_us(s.launch_end) - epoch_us(r.ts)) / 1000000.0) AS BIGINT)) ELSE r.ts END AS at
  FROM requests r LEFT JOIN starts s ON s.session_key = r.session_key AND r.header = 'ok'),
resolved AS (
  SELECT p.req_id, CASE WHEN p.header = 'ok' THEN p.session_key END AS session_key,
    coalesce(p.early, CASE WHEN h.state = 'RUNNING' THEN CASE WHEN h.address IS NULL THEN 'no_address' ELSE 'ok' END
      WHEN h.state IS NULL THEN 'not_found' WHEN h.state = 'LAUNCHING' THEN 'pending' ELSE 'bad_state' END) AS outcome,
    CASE WHEN p.early IS NULL THEN h.state END AS state,
    CASE WHEN p.early IS NULL AND h.state = 'RUNNING' THEN concat('http://', h.address, p.path) END AS target,
    CASE WHEN p.early IS NULL THEN p.at END AS answered_at
  FROM placed p LEFT JOIN history h ON h.session_key = p.session_key
    AND h.valid_from <= p.at AND (h.valid_to IS NULL OR p.at < h.valid_to) AND h.valid_from IS DISTINCT FROM h.valid_to)"""

# What each request finds with the connections that tokens keep.
_CACHED = f"""{_HISTORY},
ended AS (SELECT session_key, ts FROM fx_lifecycle WHERE kind IN ('unregister', 'stop')),
requests AS (
  SELECT req_id, ts, CASE WHEN req_id % 10 <> 4 THEN session_key END AS session_key, path, {_HEADER} AS header,
    {_TOKEN} AS token, conn_token FROM fx_requests WHERE {_GRPC}),
sessions AS (
  SELECT h.session_key, h.valid_from AS created_at, h.valid_to AS launch_end, (SELECT min(e.ts) FROM ended e WHERE e.session_key = h.session_key) AS first_end
  FROM history h WHERE h.state = 'LAUNCHING'),
judged AS (
  SELECT r.*, s.launch_end, s.first_end,
    CASE WHEN r.header <> 'ok' THEN 'unauthenticated' WHEN s.created_at IS NULL OR s.created_at > r.ts THEN 'not_found'
         WHEN r.token <> r.conn_token THEN 'token_mismatch' END AS early
  FROM requests r LEFT JOIN sessions s ON s.session_key = r.session_key AND r.header = 'ok'),
firsts AS (SELECT session_key AS first_key, min(ts) AS first_ts FROM judged WHERE early IS NULL GROUP BY session_key),
freed AS (
  SELECT j.*, CASE WHEN f.first_ts < j.launch_end
      THEN f.first_ts + to_seconds(CAST(ceil((epoch_us(j.launch_end) - epoch_us(f.first_ts)) / 1000000.0) AS BIGINT)) END AS free_at
  FROM judged j LEFT JOIN firsts f ON f.first_key = j.session_key),
placed AS (SELECT *, CASE WHEN early IS NULL AND ts < free_at THEN free_at ELSE ts END AS seen_at FROM freed),
closed AS (
  SELECT *, coalesce(early IS NULL AND ts < first_end AND first_end <= seen_at, FALSE) AS is_over,
    coalesce(early, CASE WHEN launch_end IS NULL THEN 'pending' END) AS stopped_by,
    (SELECT max(e.ts) FROM ended e WHERE e.session_key = p.session_key AND e.ts <= p.ts) AS generation FROM placed p),
seen AS (
  SELECT c.*, h.state, h.address, stopped_by IS NULL AND NOT is_over AS looked
  FROM closed c LEFT JOIN history h ON h.session_key = c.session_key AND c.stopped_by IS NULL AND NOT c.is_over
    AND h.valid_from <= c.seen_at AND (h.valid_to IS NULL OR c.seen_at < h.valid_to) AND h.valid_from IS DISTINCT FROM h.valid_to),
openers AS (
  SELECT session_key AS open_key, generation AS open_generation, arg_min(s, (ts, req_id)) AS o
  FROM seen s WHERE looked AND state = 'RUNNING' AND address IS NOT NULL GROUP BY session_key, generation),
cached AS (
  SELECT s.*, o.req_id AS opener, o.address AS open_address, o.seen_at AS opened_at,
    coalesce(looked AND (s.ts > o.ts OR s.ts = o.ts AND s.req_id > o.req_id), FALSE) AS is_cached, coalesce(looked AND state = 'RUNNING' AND address IS NOT NULL, FALSE) AS opens
  FROM seen s LEFT JOIN openers ON open_key = s.session_key AND open_generation IS NOT DISTINCT FROM s.generation)
SELECT req_id, CASE WHEN header = 'ok' THEN session_key END AS session_key,
  CASE WHEN is_cached THEN 'ok' WHEN stopped_by IS NOT NULL THEN stopped_by WHEN is_over OR state IS NULL THEN 'not_found' WHEN opens THEN 'ok'
    WHEN state = 'RUNNING' THEN 'no_address' WHEN state = 'LAUNCHING' THEN 'pending' ELSE 'bad_state' END AS outcome,
  CASE WHEN NOT is_cached THEN state END AS state,
  CASE WHEN is_cached THEN concat('http://', open_address, path) WHEN opens THEN concat('http://', address, path) END AS target,
  CASE WHEN is_cached THEN greatest(ts, opened_at) WHEN looked OR is_over THEN seen_at END AS answered_at,
  CASE WHEN is_cached OR opens THEN opener END AS opened_by
FROM cached"""

_RUNS = """
begun AS (
  SELECT c.*, (SELECT max(b.ts) FROM fx_connects b WHERE b.session_key = c.session_key AND b.attempt = 1 AND b.ts <= c.ts) AS started_at FROM fx_connects c),
runs AS (
  SELECT session_key, started_at, count(*) AS attempts, NOT bool_or(ok) AND count(DISTINCT attempt) = 4 AS failed
  FROM begun WHERE started_at IS NOT NULL GROUP BY session_key, started_at)"""

_CONNECTED = f"""{_RESOLVED},{_RUNS},
broken AS (
  SELECT DISTINCT (SELECT arg_max(s.req_id, (s.answered_at, s.req_id)) FROM resolved s
    WHERE s.outcome = 'ok' AND s.session_key = r.session_key AND s.answered_at <= r.started_at) AS req_id
  FROM runs r WHERE r.failed),
connected AS (
  SELECT s.req_id, s.session_key, CASE WHEN b.req_id IS NULL THEN s.outcome ELSE 'upstream_connect' END AS outcome, s.state,
    CASE WHEN b.req_id IS NULL THEN s.target END AS target, s.answered_at
  FROM resolved s LEFT JOIN broken b ON b.req_id = s.req_id)"""

_CODE = """CASE WHEN outcome = 'ok' THEN 0 WHEN outcome IN ('unauthenticated', 'token_mismatch') THEN 16 WHEN outcome = 'not_found' THEN 5
  WHEN outcome IN ('no_address', 'upstream_connect') THEN 14 WHEN outcome = 'bad_state' THEN 9 END"""

_VERSIONED = """
picked AS (
  SELECT l.*, v.version, v.home, v.master, v.deploy_mode, v.proxy_user
  FROM fx_launches l LEFT JOIN fx_versions v
    ON v.version = coalesce(l.version_name, (SELECT version FROM fx_versions ORDER BY ord LIMIT 1)))"""

_CONFIG = f"""{_VERSIONED},
accepted AS (SELECT *, session_id % 5 = 0 AS packaged FROM picked WHERE version IS NOT NULL),
base AS (
  SELECT u.session_id, u.conf_key, u.conf_value FROM fx_user_conf u JOIN accepted USING (session_id)
  UNION ALL
  SELECT a.session_id, l.conf_key, l.conf_value FROM accepted a JOIN fx_conf_layers l ON l.version = a.version AND l.layer = 'default'
  WHERE NOT EXISTS (SELECT 1 FROM fx_user_conf u WHERE u.session_id = a.session_id AND u.conf_key = l.conf_key)),
merged AS (
  SELECT b.session_id, b.conf_key, CASE WHEN m.conf_value IS NULL THEN b.conf_value ELSE concat(b.conf_value, ',', m.conf_value) END AS conf_value
  FROM base b JOIN accepted a USING (session_id)
  LEFT JOIN fx_conf_layers m ON m.version = a.version AND m.layer = 'merge' AND m.conf_key = b.conf_key
  UNION ALL
  SELECT a.session_id, m.conf_key, m.conf_value FROM accepted a JOIN fx_conf_layers m ON m.version = a.version AND m.layer = 'merge'
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.session_id = a.session_id AND b.conf_key = m.conf_key)),
overridden AS (
  SELECT m.* FROM merged m JOIN accepted a USING (session_id)
  WHERE NOT EXISTS (SELECT 1 FROM fx_conf_layers o WHERE o.version = a.version AND o.layer = 'override' AND o.conf_key = m.conf_key)
  UNION ALL
  SELECT a.session_id, o.conf_key, o.conf_value FROM accepted a JOIN fx_conf_layers o ON o.version = a.version AND o.layer = 'override'),
internal AS (
  SELECT session_id, unnest(['spark.connect.authenticate.token', 'spark.fleet.callback', 'spark.fleet.idle.timeout',
      'spark.extraListeners', 'spark.connect.grpc.interceptor.classes', 'spark.connect.grpc.binding.port']) AS conf_key,
    unnest([token, 'http://proxy:8100', '3600', 'fleet.SessionListener', 'fleet.SessionInterceptor', '0']) AS conf_value FROM accepted
  UNION ALL
  SELECT a.session_id, 'spark.app.name', coalesce(a.app_name, o.conf_value, concat('fleet-session-', CAST(a.session_id AS VARCHAR)))
  FROM accepted a LEFT JOIN overridden o ON o.session_id = a.session_id AND o.conf_key = 'spark.app.name'
  UNION ALL
  SELECT a.session_id, 'spark.archives', CASE WHEN coalesce(o.conf_value, '') = '' THEN '/tmp/env.tgz#environment'
    ELSE concat(o.conf_value, ',/tmp/env.tgz#environment') END
  FROM accepted a LEFT JOIN overridden o ON o.session_id = a.session_id AND o.conf_key = 'spark.archives' WHERE a.packaged
  UNION ALL
  SELECT session_id, 'spark.sql.execution.pyspark.python', '../environment/bin/python' FROM accepted WHERE packaged),
config AS (
  SELECT o.session_id, o.conf_key, o.conf_value FROM overridden o ANTI JOIN internal i USING (session_id, conf_key)
  UNION ALL SELECT * FROM internal)"""

_FINDINGS = """
pieces AS (
  SELECT session_id, conf_key, unnest(range(len(string_split(conf_value, ',')))) AS pos, trim(unnest(string_split(conf_value, ','))) AS entry,
    CASE conf_key WHEN 'spark.files' THEN 1 WHEN 'spark.archives' THEN 2 ELSE 3 END AS key_rank
  FROM fx_user_conf WHERE conf_key IN ('spark.files', 'spark.archives', 'spark.submit.pyFiles')),
findings AS (
  SELECT session_id, conf_key, CAST(pos AS INTEGER) AS pos, entry,
    CASE WHEN NOT contains(entry, '://') THEN 'no_protocol' ELSE 'file_protocol' END AS reason,
    row_number() OVER (PARTITION BY session_id ORDER BY key_rank, pos) = 1 AS is_first
  FROM pieces WHERE entry <> '' AND (NOT contains(entry, '://') OR starts_with(entry, 'file://')))"""

_WALK = """
spans AS (SELECT session_key, min(start_ts) AS t0 FROM fx_activity GROUP BY session_key),
acts AS (
  SELECT a.session_key, epoch_us(s.t0) AS z, epoch_us(start_ts) AS s,
    greatest(epoch_us(start_ts), epoch_us(s.t0) + (CAST(ceil((epoch_us(end_ts) - epoch_us(s.t0)) / 60000000.0) AS BIGINT) - 1) * 60000000) AS e
  FROM fx_activity a JOIN spans s USING (session_key) WHERE control IS NULL),
walk AS (
  SELECT *, greatest(z, coalesce(max(e) OVER (PARTITION BY session_key ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), z)) AS m FROM acts),
looks AS (SELECT *, CAST(floor((m + 21600000000 - z) / 60000000.0) AS BIGINT) + 1 AS look FROM walk),
breaks AS (SELECT session_key, min(look) AS look FROM looks WHERE s > z + look * 60000000 GROUP BY session_key),
ends AS (
  SELECT session_key, CAST(floor((greatest(max(e), max(z)) + 21600000000 - max(z)) / 60000000.0) AS BIGINT) + 1 AS look FROM acts GROUP BY session_key),
stops AS (
  SELECT p.session_key, p.t0, p.t0 + to_minutes(coalesce(b.look, n.look, 361)) AS stop
  FROM spans p LEFT JOIN breaks b USING (session_key) LEFT JOIN ends n USING (session_key))"""

_SNAPSHOT = _sql(
    ["fx_registry", "fx_requests"],
    f"""--ctes
calls AS (SELECT req_id, path, conn_token, {_HEADER} AS header, {_TOKEN} AS token FROM fx_requests WHERE {_GRPC}),
judged AS (
  SELECT c.*, r.id, r.state, r.address, CASE WHEN header <> 'ok' THEN 'unauthenticated' WHEN r.id IS NULL THEN 'not_found'
WHEN c.token <> c.conn_token THEN 'token_mismatch' WHEN r.state = 'LAUNCHING' THEN 'waiting'
WHEN r.state = 'RUNNING' THEN CASE WHEN r.address IS NULL THEN 'no_address' ELSE 'ok' END ELSE 'bad_state' END AS outcome
  FROM calls c LEFT JOIN fx_registry r ON r.token = c.token)
SELECT req_id, id, outcome, CASE WHEN outcome NOT IN ('unauthenticated', 'not_found', 'token_mismatch') THEN state END AS state,
  CASE WHEN outcome = 'ok' THEN concat('http://', address, path) END AS target FROM judged""",
)

ORACLES: dict[str, str] = {
    "list_sessions": _sql(
        ["fx_registry"],
        """SELECT id, name, token, state, address IS NOT NULL AS active,
  CASE WHEN application_id <> '' THEN concat('https://ui.example/', application_id) END AS ui_url, CAST(NULL AS VARCHAR) AS log_url
FROM fx_registry WHERE username = 'user-5' AND state IN ('RUNNING', 'FINISHED')
  AND created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'""",
    ),
    "lookup_sessions": _sql(
        ["fx_registry", "fx_stops"],
        """SELECT k.username, k.id, r.id IS NOT NULL AS found, r.name, r.token, r.state, CASE WHEN r.id IS NOT NULL THEN r.address IS NOT NULL END AS active,
  CAST(NULL AS VARCHAR) AS ui_url, CAST(NULL AS VARCHAR) AS log_url
FROM (SELECT DISTINCT username, id FROM fx_stops) k LEFT JOIN fx_registry r ON r.username = k.username AND r.id = k.id""",
    ),
    "register_sessions": _sql(
        ["fx_launches"],
        """SELECT 1000000 + row_number() OVER (ORDER BY launched_at + to_microseconds((session_id % 1000) * 1000), session_id) AS id, launched_at AS created_at, username, app_name AS name,
  'LAUNCHING' AS state, token, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS application_id FROM fx_launches""",
    ),
    "apply_registrations": _update(
        ["fx_token_events"], _LAST_REGISTER, "h.token = r.token", "RUNNING", "h.address", "h.application_id"
    ),
    "apply_registrations_unmatched": _sql(
        ["fx_registry", "fx_token_events"],
        "SELECT DISTINCT token FROM fx_token_events WHERE kind = 'register' AND token NOT IN (SELECT token FROM fx_registry)",
    ),
    "apply_unregistrations": _update(
        ["fx_token_events"],
        "SELECT DISTINCT token, TRUE AS hit FROM fx_token_events WHERE kind = 'unregister'",
        "h.token = r.token",
        "FINISHED",
        "NULL",
        "r.application_id",
    ),
    "apply_unregistrations_unmatched": _sql(
        ["fx_registry", "fx_token_events"],
        "SELECT DISTINCT token FROM fx_token_events WHERE kind = 'unregister' AND token NOT IN (SELECT token FROM fx_registry)",
    ),
    "apply_stops": _update(
        ["fx_stops"],
        "SELECT DISTINCT username, id, TRUE AS hit FROM fx_stops",
        "h.id = r.id AND h.username = r.username",
        "FINISHED",
        "NULL",
        "r.application_id",
    ),
    "apply_stops_unmatched": _sql(
        ["fx_registry", "fx_stops"],
        """SELECT DISTINCT username, id FROM fx_stops s
WHERE NOT EXISTS (SELECT 1 FROM fx_registry r WHERE r.id = s.id AND r.username = s.username)""",
    ),
    "apply_stops_to_signal": _sql(
        ["fx_registry", "fx_stops"],
        """SELECT id, address, token FROM fx_registry r
WHERE address IS NOT NULL AND EXISTS (SELECT 1 FROM fx_stops s WHERE r.id = s.id AND r.username = s.username)""",
    ),
    "apply_launch_failures": _update(
        ["fx_token_events"],
        "SELECT DISTINCT id, TRUE AS hit FROM fx_token_events WHERE kind = 'launch_failed'",
        "h.id = r.id",
        "FAILED",
        "r.address",
        "r.application_id",
        guard="r.state = 'LAUNCHING'",
    ),
    "apply_connect_failures": _update(
        ["fx_probes"],
        """SELECT token, TRUE AS hit FROM fx_probes p JOIN fx_registry r USING (id)
WHERE attempt <= 4 GROUP BY token HAVING count(*) = 4 AND NOT bool_or(ok)""",
        "h.token = r.token",
        "FAILED",
        "NULL",
        "r.application_id",
    ),
    "apply_spawn_failures": _update(
        ["fx_token_events"],
        "SELECT DISTINCT id, TRUE AS hit FROM fx_token_events WHERE kind = 'launch_failed'",
        "h.id = r.id",
        "FAILED",
        "r.address",
        "r.application_id",
    ),
    "apply_events": _sql(_EVENT_VIEWS, f"--ctes{_EFFECTS}\nSELECT {_ALL} FROM after"),
    "apply_events_touched": _sql(_EVENT_VIEWS, f"--ctes{_EFFECTS}\nSELECT {_ALL} FROM after WHERE hit"),
    "event_effects": _sql(_EVENT_VIEWS, f"--ctes{_EFFECTS}\nSELECT * FROM judged"),
    "event_effect_counts": _sql(
        _EVENT_VIEWS,
        f"""--ctes{_EFFECTS}
SELECT kind, count(DISTINCT seq) AS events, count(DISTINCT CASE WHEN matched THEN seq END) AS matched,
  count(*) FILTER (WHERE effective) AS rows FROM judged GROUP BY kind""",
    ),
    "parse_callbacks": _sql(
        ["fx_token_events"],
        """SELECT seq, token,
  CASE seq % 5 WHEN 0 THEN address WHEN 1 THEN coalesce(address, '') WHEN 2 THEN 'h:1' WHEN 4 THEN 'h:1' END AS address,
  CASE seq % 5 WHEN 0 THEN application_id WHEN 1 THEN 'a "quoted" \\ name' WHEN 4 THEN kind END AS application_id,
  CASE seq % 5 WHEN 0 THEN address IS NOT NULL AND application_id IS NOT NULL WHEN 1 THEN TRUE WHEN 4 THEN TRUE ELSE FALSE END AS accepted
FROM fx_token_events""",
    ),
    "update_counts": _sql(
        ["fx_registry", "fx_token_events", "fx_stops", "fx_probes"],
        f"""SELECT 'apply_registrations' AS update, count(*) AS rows FROM fx_registry WHERE token IN (SELECT token FROM fx_token_events WHERE kind = 'register')
UNION ALL SELECT 'apply_unregistrations', count(*) FROM fx_registry WHERE token IN (SELECT token FROM fx_token_events WHERE kind = 'unregister')
UNION ALL SELECT 'apply_stops', count(*) FROM fx_registry r WHERE EXISTS (SELECT 1 FROM fx_stops s WHERE s.id = r.id AND s.username = r.username)
UNION ALL SELECT 'apply_launch_failures', count(*) FROM fx_registry WHERE state = 'LAUNCHING' AND id IN (SELECT id FROM fx_token_events WHERE kind = 'launch_failed')
UNION ALL SELECT 'apply_connect_failures', count(*) FROM fx_registry WHERE id IN (
  SELECT id FROM fx_probes WHERE attempt <= 4 GROUP BY id HAVING count(*) = 4 AND NOT bool_or(ok))
UNION ALL SELECT 'health_sweep', count(*) FROM fx_registry r WHERE {_SICK}""",
    ),
    "prune_terminal": _sql(["fx_registry"], f"SELECT {_ALL} FROM fx_registry WHERE {_OLD}"),
    "prune_terminal_kept": _sql(["fx_registry"], f"SELECT {_ALL} FROM fx_registry WHERE NOT ({_OLD})"),
    "health_sweep": _sql(
        ["fx_registry", "fx_probes"],
        f"""SELECT id, created_at, username, name, CASE WHEN {_SICK} THEN 'FAILED' ELSE state END AS state, token,
  CASE WHEN {_SICK} THEN NULL ELSE address END AS address, application_id FROM fx_registry r""",
    ),
    "health_sweep_failed": _sql(
        ["fx_registry", "fx_probes"],
        f"""SELECT id, created_at, username, name, 'FAILED' AS state, token, CAST(NULL AS VARCHAR) AS address, application_id
FROM fx_registry r WHERE {_SICK}""",
    ),
    "fold_lifecycle": _sql(["fx_lifecycle"], _FOLD),
    "session_history": _sql(["fx_lifecycle"], f"--ctes{_HISTORY}\nSELECT * FROM history"),
    "incremental_session_history": _sql(["fx_lifecycle"], f"--ctes{_HISTORY}\nSELECT * FROM history"),
    "registry_store_lookup": _sql(
        ["fx_registry"], f"SELECT {_ALL} FROM fx_registry WHERE id IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 35)"
    ),
    "registry_store_update": _sql(_EVENT_VIEWS, f"--ctes{_EFFECTS}\nSELECT {_ALL} FROM after"),
    "launch_timeouts": _sql(
        ["fx_launch_events"],
        """--ctes
outcomes AS (
  SELECT l.session_key, l.event_id, l.ts, l.ts + INTERVAL '21600' SECOND AS deadline,
    min(e.ts) FILTER (WHERE e.kind = 'callback') AS cb, min(e.ts) FILTER (WHERE e.kind = 'exit_nonzero') AS ex
  FROM fx_launch_events l LEFT JOIN fx_launch_events e
    ON e.session_key = l.session_key AND e.ts >= l.ts AND e.kind <> 'launch' AND e.ts <= TIMESTAMP '2024-01-31'
  WHERE l.kind = 'launch' AND l.ts <= TIMESTAMP '2024-01-31' GROUP BY ALL),
judged AS (
  SELECT *, least(deadline, ex) AS fails_at,
    CASE WHEN cb <= least(deadline, ex) THEN 'registered' WHEN ex <= deadline THEN 'exited'
         WHEN deadline <= TIMESTAMP '2024-01-31' THEN 'timed_out' ELSE 'pending' END AS outcome FROM outcomes)
SELECT session_key, event_id AS launch_id, ts AS launched_at, cb AS registered_at,
  CASE WHEN outcome IN ('exited', 'timed_out') THEN fails_at END AS failed_at, outcome,
  outcome IN ('exited', 'timed_out') AND cb IS NOT NULL AS revived FROM judged""",
    ),
    "idle_sessions": _sql(
        ["fx_activity"],
        f"""--ctes{_WALK}
SELECT s.session_key, s.t0 AS started_at, CASE WHEN s.stop <= TIMESTAMP '2024-02-15' THEN s.stop END AS stopped_at,
  count(a.control IS NULL OR NULL) AS activities, count((a.control IS NULL AND a.start_ts > s.stop) OR NULL) AS after_stop
FROM stops s JOIN fx_activity a USING (session_key) GROUP BY ALL""",
    ),
    "traffic_by_route": _sql(
        ["fx_requests"], f"SELECT {_ROUTE} AS route, method, count(*) AS requests FROM fx_requests GROUP BY ALL"
    ),
    "auth_header_audit": _sql(
        ["fx_requests"],
        f"""--ctes
routed AS (SELECT auth_header AS h, {_ROUTE} AS route, {_HEADER} AS grpc_outcome FROM fx_requests)
SELECT CASE WHEN route IN ('grpc', 'callback') THEN route WHEN route IN ('apps', 'app', 'versions', 'rest_bad_id') THEN 'user' ELSE 'none' END AS surface,
  CASE WHEN route = 'grpc' THEN grpc_outcome
       WHEN route = 'callback' THEN CASE WHEN starts_with(h, 'Bearer ') THEN 'ok' ELSE 'unauthorized' END
       WHEN route IN ('apps', 'app', 'versions', 'rest_bad_id') THEN CASE WHEN starts_with(h, 'Bearer ') THEN 'token' ELSE 'no_token' END
       ELSE 'not_checked' END AS outcome, count(*) AS requests
FROM routed GROUP BY ALL""",
    ),
    "resolve_identity": _sql(
        ["fx_auth_attempts"],
        """--ctes
winners AS (
  SELECT req_id, min(method_ord) FILTER (WHERE username IS NOT NULL) AS method_ord FROM fx_auth_attempts GROUP BY req_id)
SELECT w.req_id, min(a.username) FILTER (WHERE a.method_ord = w.method_ord) AS username, w.method_ord,
  count(*) FILTER (WHERE a.error IS NOT NULL AND (w.method_ord IS NULL OR a.method_ord < w.method_ord)) AS errors_before,
  CASE WHEN w.method_ord IS NULL THEN 401 ELSE 200 END AS status
FROM winners w JOIN fx_auth_attempts a USING (req_id) GROUP BY w.req_id, w.method_ord""",
    ),
    "resolve_requests": _sql(["fx_lifecycle", "fx_requests"], f"--ctes{_RESOLVED}\nSELECT * FROM resolved"),
    "resolve_against_snapshot": _SNAPSHOT,
    "request_outcomes": _sql(
        ["fx_lifecycle", "fx_requests"],
        f"--ctes{_RESOLVED}\nSELECT outcome, {_CODE} AS code, count(*) AS requests FROM resolved GROUP BY ALL",
    ),
    "resolve_cached_requests": _sql(["fx_lifecycle", "fx_requests"], f"--ctes{_CACHED}"),
    "connect_runs": _sql(["fx_connects"], f"--ctes{_RUNS}\nSELECT * FROM runs"),
    "resolve_with_connects": _sql(["fx_lifecycle", "fx_requests", "fx_connects"], f"--ctes{_CONNECTED}\nSELECT * FROM connected"),
    "request_outcomes_with_connects": _sql(
        ["fx_lifecycle", "fx_requests", "fx_connects"],
        f"--ctes{_CONNECTED}\nSELECT outcome, {_CODE} AS code, count(*) AS requests FROM connected GROUP BY ALL",
    ),
    "upstream_reuse": _sql(
        ["fx_lifecycle", "fx_requests"],
        f"""--ctes
valid AS (
  SELECT * FROM fx_requests r WHERE {_GRPC} AND {_HEADER} = 'ok' AND req_id % 10 <> 4
    AND r.ts >= (SELECT date_trunc('day', min(l.ts)) FROM fx_lifecycle l WHERE l.session_key = r.session_key)),
generations AS (
  SELECT v.session_key, v.req_id, (SELECT count(*) FROM fx_lifecycle l
    WHERE l.session_key = v.session_key AND l.kind IN ('unregister', 'stop') AND l.ts <= v.ts) AS generation FROM valid v)
SELECT session_key, count(*) - count(DISTINCT generation) AS hits, count(DISTINCT generation) AS misses FROM generations GROUP BY session_key""",
    ),
    "token_mismatches": _sql(
        ["fx_requests"],
        f"""SELECT req_id, ts, left(conn_token, 8) AS conn_prefix, left({_TOKEN}, 8) AS token_prefix
FROM fx_requests WHERE {_GRPC} AND {_TOKEN} <> conn_token""",
    ),
    "control_traffic": _sql(
        ["fx_requests"],
        f"""SELECT CASE WHEN control IS NULL THEN 'NORMAL' WHEN control = 'health' THEN 'OK' WHEN control = 'stop' THEN 'CANCELLED'
  ELSE 'INVALID_ARGUMENT' END AS answer, control IS NULL AS is_activity, coalesce(control = 'stop', FALSE) AS shuts_down, count(*) AS requests
FROM fx_requests WHERE {_GRPC} GROUP BY ALL""",
    ),
    "resolve_versions": _sql(
        ["fx_launches", "fx_versions"],
        f"""--ctes{_VERSIONED}
SELECT session_id, launched_at, username, version_name, app_name, token, version,
  CASE WHEN version IS NULL THEN 'not_found' ELSE 'found' END AS version_status, home, master, deploy_mode, proxy_user FROM picked""",
    ),
    "effective_config": _sql(
        ["fx_launches", "fx_user_conf", "fx_conf_layers", "fx_versions"], f"--ctes{_CONFIG}\nSELECT * FROM config"
    ),
    "config_policy_violations": _sql(["fx_user_conf"], f"--ctes{_FINDINGS}\nSELECT * FROM findings"),
    "launch_specs": _sql(
        ["fx_launches", "fx_user_conf", "fx_conf_layers", "fx_versions"],
        f"""--ctes{_CONFIG},{_FINDINGS},
lines AS (
  SELECT session_id, string_agg(concat('--conf ', conf_key, '=', conf_value), ' ' ORDER BY conf_key) AS confs FROM config GROUP BY session_id),
judged AS (
  SELECT p.*, CASE WHEN p.version IS NULL THEN 'version_not_found' ELSE f.reason END AS rejected_reason
  FROM picked p LEFT JOIN findings f ON f.session_id = p.session_id AND f.is_first)
SELECT j.session_id, CASE WHEN rejected_reason IS NULL THEN 'LAUNCHING' ELSE 'FAILED' END AS state, rejected_reason,
  CASE WHEN rejected_reason IS NULL THEN concat(home, '/bin/spark-submit') END AS command,
  CASE WHEN rejected_reason IS NULL THEN concat_ws(' ',
    CASE WHEN master IS NOT NULL THEN concat('--master ', master) END,
    CASE WHEN deploy_mode IS NOT NULL THEN concat('--deploy-mode ', deploy_mode) END,
    confs, '--class fleet.SessionServer', CASE WHEN proxy_user THEN concat('--proxy-user ', username) END, '/opt/fleet/plugin.jar') END AS args
FROM judged j LEFT JOIN lines l USING (session_id)""",
    ),
    "stream_registry": _sql(["fx_lifecycle"], _FOLD),
    # A stream and what it would report next, so all of its input.
    "stream_launch_timeouts": _sql(
        ["fx_launch_events"],
        """SELECT session_key, event_id AS launch_id, ts AS launched_at, ts + INTERVAL '6' HOUR AS failed_at
FROM fx_launch_events l
WHERE l.kind = 'launch' AND NOT EXISTS (SELECT 1 FROM fx_launch_events s WHERE s.kind <> 'launch' AND s.session_key = l.session_key
    AND s.ts BETWEEN l.ts AND l.ts + INTERVAL '6' HOUR)""",
    ),
    "stream_idle_sessions": _sql(
        ["fx_activity"],
        """--ctes
acts AS (
  SELECT session_key, start_ts, greatest(end_ts, start_ts) + INTERVAL '6' HOUR AS until FROM fx_activity WHERE control IS NULL),
breaks AS (
  SELECT *, start_ts > max(until) OVER (PARTITION BY session_key ORDER BY start_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fresh
  FROM acts),
spans AS (SELECT *, count(fresh OR NULL) OVER (PARTITION BY session_key ORDER BY start_ts) AS span FROM breaks)
SELECT session_key, min(start_ts) AS active_from, max(until) AS idle_at, count(*) AS activities FROM spans
GROUP BY session_key, span""",
    ),
    "stream_idle_stops": _sql(
        ["fx_activity"],
        f"""--ctes{_WALK}
SELECT s.session_key, s.t0 AS started_at, CASE WHEN s.stop <= TIMESTAMP '2024-02-15' THEN s.stop END AS stopped_at,
  count((a.control IS NULL AND a.start_ts <= s.stop) OR NULL) AS activities
FROM stops s JOIN fx_activity a USING (session_key) GROUP BY ALL""",
    ),
    "stream_request_resolution": _SNAPSHOT,
}

# The same rule, observed until the last event, without the launches still open.
_OBSERVED = ORACLES["launch_timeouts"].replace("TIMESTAMP '2024-01-31'", "(SELECT max(ts) FROM fx_launch_events)")
ORACLES["launch_timer_net"] = f"SELECT * FROM ({_OBSERVED}) WHERE outcome <> 'pending'"
