"""Small worked examples of every rule."""

from datetime import datetime, timedelta

import pytest
from support import rows
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.functions.headers import callback_header_outcome, grpc_header_outcome, grpc_token, user_header_outcome
from fleetlens.functions.routes import route_of
from fleetlens.functions.text import trim_whitespace
from fleetlens.operators import launch, registry, resolution, traffic, transitions

NOW = datetime(2024, 1, 1, 12, 0, 0)
SCHEMA = (
    "id long, created_at timestamp_ntz, username string, name string, state string, token string, "
    "address string, application_id string"
)


def sessions(spark, *overrides):
    made = []
    for i, row in enumerate(overrides, 1):
        base = {"id": i, "created_at": NOW, "username": "user1", "name": None, "state": S.LAUNCHING}
        base |= {"token": f"t{i}", "address": None, "application_id": None} | row
        made.append(tuple(base[c] for c in S.REGISTRY_COLUMNS))
    return spark.createDataFrame(made, SCHEMA)


def states(df):
    return {r.id: (r.state, r.address, r.application_id) for r in df.collect()}


def test_a_session_runs_ends_and_comes_back(spark):
    asked = spark.createDataFrame(
        [(20, "mira", None, "tb"), (10, "mira", "etl", "ta"), (20, "otto", "etl", "tc")], "n long, username string, name string, token string"
    )
    made = registry.register_sessions(asked, 40, F.col("n"), F.col("token"), F.lit(NOW).cast("timestamp_ntz"), F.col("token"))
    assert {r.id: r.token for r in made.collect()} == {41: "ta", 42: "tb", 43: "tc"}
    assert set(states(made).values()) == {(S.LAUNCHING, None, None)}
    events = spark.createDataFrame(
        [(5, "ta", "", "application_9"), (3, "ta", "node-1:7001", "application_8"), (4, "tc", "node-2:7002", None), (1, "zz", "node-3:1", "z")],
        "seq long, token string, address string, application_id string",
    )
    up = transitions.apply_registrations(made, events)
    assert states(up.registry) == {
        41: (S.RUNNING, "", "application_9"),
        42: (S.LAUNCHING, None, None),
        43: (S.RUNNING, "node-2:7002", None),
    }
    assert sorted(states(up.touched)) == [41, 43]
    assert rows(up.unmatched) == [("zz",)]
    assert {r.id: r.active for r in registry.list_sessions(up.registry, "mira").collect()} == {41: True, 42: False}
    down = transitions.apply_unregistrations(up.registry, events.select("token"))
    assert states(down.registry)[41] == (S.FINISHED, None, "application_9")
    again = transitions.apply_registrations(down.registry, events.where("seq = 3"))
    assert states(again.registry)[41] == (S.RUNNING, "node-1:7001", "application_8")
    assert states(again.registry)[43] == (S.FINISHED, None, None)


def test_random_tokens_differ_and_ids_run_on(spark):
    launches = spark.range(500).select(F.lit("u").alias("username"), F.lit("n").alias("name"), "id")
    for width in (None, 40):
        made = registry.register_sessions(launches, 100, F.col("id"), F.col("id"), width=width).collect()
        assert sorted(r.id for r in made) == list(range(101, 601))
        assert len({r.token for r in made}) == 500


def test_owner_isolation(spark):
    table = sessions(spark, {})
    assert registry.list_sessions(table, "user1").count() == 1
    assert registry.list_sessions(table, "user2").count() == 0
    keys = spark.createDataFrame([("user1", 1), ("user2", 1), ("user1", 9)], "username string, id long")
    assert {(r.username, r.id): r.found for r in registry.lookup_sessions(table, keys).collect()} == {
        ("user1", 1): True,
        ("user2", 1): False,
        ("user1", 9): False,
    }


def test_stop(spark):
    table = sessions(spark, {}, {"address": "h:1", "state": S.RUNNING}, {"state": S.FAILED}, {"username": "user2"})
    stops = spark.createDataFrame([("user1", i) for i in (1, 2, 2, 3, 4, 9)], "username string, id long")
    change = transitions.apply_stops(table, stops)
    assert {k: v[:2] for k, v in states(change.registry).items()} == {
        1: (S.FINISHED, None),
        2: (S.FINISHED, None),
        3: (S.FINISHED, None),
        4: (S.LAUNCHING, None),
    }
    assert rows(change.to_signal) == [(2, "h:1", "t2")]
    assert rows(change.unmatched) == [("user1", 4), ("user1", 9)]


def test_links(spark):
    template = "https://h/{{application_id}}/x/{{  application_id }}"
    table = sessions(spark, {}, {"application_id": ""}, {"application_id": r"a$1\b"})
    shown = registry.list_sessions(table, "user1", ui_template=template).orderBy("id").collect()
    assert [r.ui_url for r in shown] == [None, None, r"https://h/a$1\b/x/a$1\b"]
    assert [r.log_url for r in shown] == [None] * 3


def test_state_filter(spark):
    table = sessions(spark, *[{"state": s} for s in S.STATES])
    assert registry.list_sessions(table, "user1", state="RUNNING").count() == 1
    assert registry.list_sessions(table, "user1", state="RUNNING, FINISHED ,").count() == 2
    assert registry.list_sessions(table, "user1", state=" , ").count() == 4
    for bad in ("NOT_A_STATE", "running", "RUNNING,x"):
        with pytest.raises(ValueError):
            registry.list_sessions(table, "user1", state=bad)


def test_created_range_is_inclusive(spark):
    first, second = datetime.fromtimestamp(1700000000), datetime.fromtimestamp(1700000060)
    table = sessions(spark, {"created_at": first}, {"created_at": second})
    for at, found in ((first, 1), (second, 2)):
        shown = registry.list_sessions(table, "user1", created_after=at, created_before=f"{at.isoformat()}Z")
        assert [r.id for r in shown.collect()] == [found]
    with_offset = registry.list_sessions(table, "user1", created_after="2023-11-14T23:13:21+01:00")
    assert [r.id for r in with_offset.collect()] == [2]
    for bad in ("soon", "2023-11-14", "2023-W46-2", "2023-11-14T23:13:21", "2023-13-14T23:13:21Z"):
        with pytest.raises(ValueError):
            registry.list_sessions(table, "user1", created_after=bad)


def test_prune(spark):
    ages = [(S.FAILED, 120), (S.FINISHED, 120), (S.FAILED, 10), (S.RUNNING, 120), (S.FINISHED, 60)]
    table = sessions(spark, *[{"state": s, "created_at": NOW - timedelta(seconds=a)} for s, a in ages])
    result = transitions.prune_terminal(table, NOW + timedelta(microseconds=900_000), 60)
    assert sorted(states(result.pruned)) == [1, 2, 5]
    assert sorted(states(result.kept)) == [3, 4]
    blank = sessions(spark, {"state": None}, {"state": S.FAILED, "created_at": None}, {"state": None, "created_at": None})
    split = transitions.prune_terminal(blank, NOW, 60)
    assert (split.kept.count(), split.pruned.count()) == (3, 0)
    observed, seen = transitions.count_rows(result.pruned, "pruned")
    observed.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3}


def test_health_sweep(spark):
    running = {"state": S.RUNNING, "address": "h:1"}
    table = sessions(spark, running | {"address": None}, running, {}, running, running)
    probes = spark.createDataFrame(
        [(2, 1, False), (4, 4, True), (4, 1, False), (5, 5, True)], "id long, attempt int, ok boolean"
    )
    change = transitions.health_sweep(table, probes)
    assert {k: v[:2] for k, v in states(change.registry).items()} == {
        1: (S.FAILED, None),
        2: (S.FAILED, None),
        3: (S.LAUNCHING, None),
        4: (S.RUNNING, "h:1"),
        5: (S.FAILED, None),
    }
    assert sorted(states(change.touched)) == [1, 2, 5]


def test_connect_failures(spark):
    table = sessions(spark, *[{"state": S.RUNNING, "address": "127.0.0.1:9"}] * 4)
    tries = [("t1", n, False) for n in (1, 2, 3, 4)] + [("t2", n, n == 4) for n in (1, 2, 3, 4)]
    tries += [("t3", n, False) for n in (1, 2, 3)] + [("t4", n, False) for n in (1, 2, 3, 3, 5)]
    change = transitions.apply_connect_failures(
        table, spark.createDataFrame(tries, "token string, attempt int, ok boolean")
    )
    assert {i for i, v in states(change.registry).items() if v[:2] == (S.FAILED, None)} == {1}


def test_launch_failures_are_guarded(spark):
    table = sessions(spark, {}, {"state": S.RUNNING, "address": "h:1"})
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    assert {k: v[0] for k, v in states(transitions.apply_launch_failures(table, ids).registry).items()} == {
        1: S.FAILED,
        2: S.RUNNING,
    }
    spawn = transitions.apply_launch_failures(table, ids, guarded=False)
    assert states(spawn.registry)[2][:2] == (S.FAILED, "h:1")


def test_token_update_touches_every_row_of_the_token(spark):
    table = sessions(spark, {"token": "same"}, {"token": "same"})
    events = spark.createDataFrame([("same",)], "token string")
    assert {v[0] for v in states(transitions.apply_unregistrations(table, events).registry).values()} == {S.FINISHED}


HEADERS = [
    ("Bearer test-token", "ok", "test-token", "ok", "token"),
    (None, "missing", None, "unauthorized", "no_token"),
    ("Basic abc123", "bad_scheme", None, "unauthorized", "no_token"),
    ("Bearer a b", "ok", "a b", "ok", "token"),
    ("Bearer ", "invalid", None, "ok", "token"),
    ("Bearer", "invalid", None, "unauthorized", "no_token"),
    ("bearer x", "bad_scheme", None, "unauthorized", "no_token"),
    (" Bearer x", "bad_scheme", None, "unauthorized", "no_token"),
    ("", "invalid", None, "unauthorized", "no_token"),
    ("Bearer é", "invalid", None, "bad_request", "invalid"),
]


def test_headers(spark):
    frame = spark.createDataFrame([(i, h[0]) for i, h in enumerate(HEADERS)], "i int, h string")
    h = F.col("h")
    got = frame.select("i", grpc_header_outcome(h), grpc_token(h), callback_header_outcome(h), user_header_outcome(h))
    assert [tuple(r)[1:] for r in got.orderBy("i").collect()] == [h[1:] for h in HEADERS]


ROUTES = [
    ("POST", "/spark.connect.SparkConnectService/ExecutePlan", "grpc"),
    ("GET", "/spark.connect.SparkConnectServiceX", "grpc"),
    ("GET", "/apps", "apps"),
    ("HEAD", "/apps", "apps"),
    ("DELETE", "/apps", "method_not_allowed"),
    ("GET", "/apps/", "not_found"),
    ("GET", "/apps/12", "app"),
    ("DELETE", "/apps/-2147483648", "app"),
    ("GET", "/apps/2147483648", "rest_bad_id"),
    ("GET", "/apps/x", "rest_bad_id"),
    ("POST", "/apps/x", "method_not_allowed"),
    ("GET", "/apps/1/2", "not_found"),
    ("POST", "/versions", "method_not_allowed"),
    ("DELETE", "/callback", "callback"),
    ("GET", "/callback", "method_not_allowed"),
    ("GET", "/nope", "not_found"),
    ("GET", "/apps?state=RUNNING", "apps"),
    ("GET", "/apps/7?x=/1?y", "app"),
    ("GET", "/apps/?id=7", "not_found"),
    ("POST", "/callback?", "callback"),
    ("GET", "?/apps", "not_found"),
]


def test_routes(spark):
    frame = spark.createDataFrame([(i, m, p) for i, (m, p, _) in enumerate(ROUTES)], "i int, m string, p string")
    got = frame.select("i", route_of(F.col("m"), F.col("p")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [want for _, _, want in ROUTES]


def test_identity(spark):
    tries = [
        (1, 0, None, "bad"), (1, 1, None, None), (1, 2, "u", None), (1, 3, "v", None), (1, 4, None, "late"),
        (2, 0, None, "bad"), (2, 62, None, "bad"),
        (3, 0, None, None),
    ]
    frame = spark.createDataFrame(tries, "req_id long, method_ord int, username string, error string")
    assert rows(traffic.resolve_identity(frame)) == [(1, "u", 2, 1, 200), (2, None, None, 2, 401), (3, None, None, 0, 401)]
    many = [(4, n, "w" if n == 900 else None, "bad" if n % 2 else None) for n in range(1000)]
    assert rows(traffic.resolve_identity(spark.createDataFrame(many, frame.schema))) == [(4, "w", 900, 450, 200)]


def test_control_and_mismatch(spark):
    schema = "req_id long, ts timestamp_ntz, path string, auth_header string, conn_token string, control string"
    call = "/spark.connect.SparkConnectService/Config"
    frame = spark.createDataFrame(
        [
            (1, NOW, call, "Bearer 123456789", "abc", "health"),
            (2, NOW, call, "Bearer abc", "abc", "stop"),
            (3, NOW, "/apps", "Bearer x", "abc", "Stop"),
            (4, NOW, call, None, "abc", None),
        ],
        schema,
    )
    assert rows(traffic.token_mismatches(frame)) == [(1, NOW, "abc", "12345678")]
    assert {r.answer: (r.is_activity, r.shuts_down) for r in traffic.control_traffic(frame).collect()} == {
        "OK": (False, False),
        "CANCELLED": (False, True),
        "NORMAL": (True, False),
    }


def test_outcome_codes(spark):
    names = ["not_found", "launching", "no_address", "authorization_error", "bad_state", "internal", "ok", "pending"]
    frame = spark.createDataFrame([(n,) for n in names], "outcome string")
    got = {r.outcome: r.code for r in resolution.request_outcomes(frame).collect()}
    assert got == dict(zip(names, [5, 14, 14, 16, 9, 13, 0, None]))


CATALOGUE = "ord int, version string, home string, master string, deploy_mode string, proxy_user boolean"
LAUNCH = "session_id long, username string, version_name string, app_name string, token string, packaged boolean"
CONF = "session_id long, conf_key string, conf_value string"
LAYER = "version string, layer string, conf_key string, conf_value string"
SERVICE = launch.Service("https://fleet:9", 75, "/srv/env-7.tar.gz")


def config(spark, user, layers=(), app_name=None, packaged=False):
    return {
        r.conf_key: r.conf_value
        for r in launch.effective_config(
            spark.createDataFrame([(1, "user", None, app_name, "tok-0", packaged)], LAUNCH),
            spark.createDataFrame([(1, k, v) for k, v in user.items()], CONF),
            spark.createDataFrame([("default", *layer) for layer in layers], LAYER),
            spark.createDataFrame([(0, "default", "/opt/spark", None, None, None)], CATALOGUE),
            SERVICE,
        ).collect()
    }


def test_config_layering(spark):
    """Override beats everything; a merge is put behind what the user asked for, else behind the default, also behind an empty value."""
    layers = [("default", k, f"d{k}") for k in ("p", "q", "r", "s")] + [("merge", k, "m1,m2") for k in ("q", "r", "t", "u", "v")]
    layers += [("override", "s", "forced"), ("override", "v", ""), ("override", "w", "only")]
    got = config(spark, {"q": "mine", "s": "mine", "u": "", "v": "mine", "x": "a=b"}, layers)
    want = {"p": "dp", "q": "mine,m1,m2", "r": "dr,m1,m2", "s": "forced", "t": "m1,m2", "u": ",m1,m2", "v": "", "w": "only", "x": "a=b"}
    assert {k: got[k] for k in want} == want
    assert set(got) - set(want) == set(config(spark, {}))


def test_internal_settings_win(spark):
    got = config(spark, {launch.LISTENERS: "mine", launch.PORT: "1", launch.TOKEN: "mine"})
    assert got == {
        launch.APP_NAME: f"{SERVICE.app_name_prefix}1",
        launch.TOKEN: "tok-0",
        SERVICE.callback_key: "https://fleet:9",
        SERVICE.idle_key: "75",
        launch.LISTENERS: SERVICE.listener_class,
        launch.INTERCEPTORS: SERVICE.interceptor_class,
        launch.PORT: "0",
    }


@pytest.mark.parametrize(
    "named, asked, layer, want",
    [
        ("nightly", None, None, "nightly"),
        ("", "other", None, ""),
        ("nightly", "other", "override", "nightly"),
        (None, "other", "override", "layer"),
        (None, "other", "merge", "other,layer"),
        (None, None, "default", "layer"),
        (None, "", None, ""),
        (None, None, None, f"{SERVICE.app_name_prefix}1"),
    ],
)
def test_app_name(spark, named, asked, layer, want):
    layers = [(layer, launch.APP_NAME, "layer")] if layer else []
    assert config(spark, {} if asked is None else {launch.APP_NAME: asked}, layers, app_name=named)[launch.APP_NAME] == want


@pytest.mark.parametrize(
    "asked, layer, want",
    [("hdfs://n/x.zip,s3://y#z", None, "hdfs://n/x.zip,s3://y#z,"), ("", None, ""), (None, None, ""), (None, "default", "layer,"), ("", "merge", ",layer,")],
)
def test_archives(spark, asked, layer, want):
    layers = [(layer, launch.ARCHIVES, "layer")] if layer else []
    user = {} if asked is None else {launch.ARCHIVES: asked}
    got = config(spark, user, layers, packaged=True)
    assert got[launch.ARCHIVES] == f"{want}{SERVICE.tarball}#environment"
    assert got[launch.PYTHON] == launch.ENVIRONMENT_PYTHON
    assert launch.PYTHON not in config(spark, user, layers)


def test_file_policy(spark):
    conf = [
        (10, "spark.archives", "hdfs://n/one.zip , s3a://b/two.zip#t"),
        (10, "spark.files", ""),
        (11, "spark.submit.pyFiles", "lib.py,,file://lib.py,://odd"),
        (12, "spark.submit.pyFiles", "C:/x"),
        (12, "spark.archives", ",\t,file:///a , file:/b"),
        (12, "spark.files", "File://kept,ftp://kept"),
        (13, "spark.jars", "anything"),
    ]
    assert rows(launch.config_policy_violations(spark.createDataFrame(conf, CONF))) == [
        (11, "spark.submit.pyFiles", 0, "lib.py", "no_protocol", True),
        (11, "spark.submit.pyFiles", 2, "file://lib.py", "file_protocol", False),
        (12, "spark.archives", 2, "file:///a", "file_protocol", True),
        (12, "spark.archives", 3, "file:/b", "no_protocol", False),
        (12, "spark.submit.pyFiles", 0, "C:/x", "no_protocol", False),
    ]


def test_specs_and_versions(spark):
    versions = spark.createDataFrame(
        [(1, "b", "/b", "yarn", "cluster", True), (0, "a", "/a", None, None, None), (2, "b", "/late", None, None, None)],
        CATALOGUE,
    )
    launches = spark.createDataFrame(
        [(1, "u", None, None, "t", None), (2, "u", "b", "n", "t", None), (3, "u", "zz", None, "t", None), (4, "u", "a", None, "t", None)],
        LAUNCH,
    )
    conf = spark.createDataFrame([(2, "k", "v"), (3, "spark.files", "x"), (4, "spark.files", "x")], CONF)
    assert [r.version for r in launch.list_versions(versions).collect()] == ["a", "b", "b"]
    layers = spark.createDataFrame([], LAYER)
    found = {r.session_id: (r.version, r.home) for r in launch.resolve_versions(launches, versions).collect()}
    assert found == {1: ("a", "/a"), 2: ("b", "/b"), 3: (None, None), 4: ("a", "/a")}
    specs = {r.session_id: r for r in launch.launch_specs(launches, conf, layers, versions, SERVICE).collect()}
    assert {i: (s.state, s.rejected_reason) for i, s in specs.items()} == {
        1: ("LAUNCHING", None),
        2: ("LAUNCHING", None),
        3: ("FAILED", "version_not_found"),
        4: ("FAILED", "no_protocol"),
    }
    args = specs[2].args
    assert specs[2].command == "/b/bin/spark-submit"
    assert args[:4] == ["--master", "yarn", "--deploy-mode", "cluster"]
    assert args[args.index("k=v") - 1] == "--conf"
    assert args[-5:] == ["--class", SERVICE.main_class, "--proxy-user", "u", SERVICE.plugin]
    assert specs[3].args is None


def test_trim(spark):
    frame = spark.createDataFrame([("   a b\t\n",)], "x string")
    assert frame.select(trim_whitespace(F.col("x"))).first()[0] == "a b"
