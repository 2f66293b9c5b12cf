"""Literal fixtures and edge cases."""

from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import ids, text
from fleetlens.operators import cluster, metrics, relations, rows, slo, tracking, validate
from fleetlens.operators.inference import predict
from fleetlens.plans.joins_q import tenant_policies
from fleetlens.sources import files, queue
from fleetlens.streaming.runs import run_to_end

T0 = datetime(2024, 1, 1)


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


# organizations -------------------------------------------------------------


@pytest.fixture(scope="module")
def staff(spark):
    org = spark.createDataFrame([(1, "Northwind", "1 Harbour Road, Oslo"), (2, "Lakeside", "2 Mill Lane, Bern")], "id long, name string, address string")
    dept = spark.createDataFrame(
        [(1, 1, "Development"), (2, 1, "Operations"), (3, 2, "Development"), (4, 2, "Operations"), (5, 2, "Empty")],
        "id long, organizationId long, name string",
    )
    emp = spark.createDataFrame(
        [
            (1, 1, 1, "John Smith"), (2, 1, 1, "Darren Hamilton"), (3, 1, 1, "Tom Scott"), (4, 1, 2, "Anna London"),
            (5, 1, 2, "Patrick Dempsey"), (6, 2, 3, "Kevin Price"), (7, 2, 3, "Ian Scott"), (8, 2, 3, "Andrew Campton"),
            (9, 2, 4, "Steve Franklin"), (10, 2, 4, "Elisabeth Smith"),
        ],
        "id long, organizationId long, departmentId long, name string",
    )
    return org, dept, emp


def test_nesting(staff):
    org, dept, emp = staff
    out = {r["id"]: r for r in relations.nest(dept, emp, "id", "departmentId", "employees", ["id"], ["id", "name"]).collect()}
    assert [e["id"] for e in out[1]["employees"]] == [1, 2, 3]
    assert out[5]["employees"] == [] and out[5]["page"] == 0
    tree = relations.nest2(org, dept, emp, "id", "organizationId", "id", "departmentId", ("departments", "employees"), ["id", "name"], ["id", "name"])
    first = {r["id"]: r for r in tree.collect()}[1]
    assert [(d["id"], len(d["employees"])) for d in first["departments"]] == [(1, 3), (2, 2)]


@pytest.mark.parametrize("limit", [10**9, 2])
def test_long_lists_go_on_in_pages(staff, limit):
    _, dept, emp = staff
    out = relations.nest(dept, emp, "id", "departmentId", "employees", ["id"], ["id"], page_rows=2, rows_per_task=limit)
    pages = sorted((r["id"], r["page"], [e["id"] for e in r["employees"]]) for r in out.collect())
    assert pages == [(1, 0, [1, 2]), (1, 1, [3]), (2, 0, [4, 5]), (3, 0, [6, 7]), (3, 1, [8]), (4, 0, [9, 10]), (5, 0, [])]


def test_lookup_and_filter(staff):
    _, dept, emp = staff
    assert col(rows.filter_by(emp, organizationId=2), "id") == [6, 7, 8, 9, 10]
    assert col(rows.lookup(emp, "departmentId", 3, "id"), "id") == [6]
    assert rows.lookup(emp, "id", 99, "id").count() == 0


# users and posts -----------------------------------------------------------


def test_posts(spark):
    users = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie")], "id int, name string")
    posts = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 1), (4, "d", 999)], "id int, content string, user_id int")
    ok, orphan = relations.enforce_fk(posts, users, "user_id", "id")
    assert (ok.count(), col(orphan, "user_id")) == (3, [999])
    assert {r["user_id"]: r["posts"] for r in metrics.posts_by_user(ok, "user_id").collect()} == {1: 2, 2: 1}
    left, posts_left = relations.delete_cascade(users, ok, users.filter("id = 1").select("id"), "id", "user_id")
    assert sorted(col(left, "id")) == [2, 3] and col(posts_left, "id") == [2]


def test_patch_tells_unset_from_null(spark):
    base = spark.createDataFrame([(1, "a", "x", "h", T0), (2, "b", "y", "h", T0)], "id int, name string, title string, hashed string, updated_at timestamp")
    patches = spark.createDataFrame([(1, ["title", "password"], "new", None, "secret")], "id int, set_fields array<string>, name string, title string, password string")
    out = {r["id"]: r for r in relations.patch(base, patches, "id", F.lit("2025-01-01").cast("timestamp"), password="password", hashed="hashed").collect()}
    assert (out[1]["name"], out[1]["title"], out[1]["updated_at"].year) == ("a", None, 2025)
    assert len(out[1]["hashed"]) == 64 and out[2]["hashed"] == "h" and out[2]["updated_at"] == T0
    assert "password" not in base.columns


def test_reject_duplicates(spark):
    old = spark.createDataFrame([(0, "a@x", "anna")], "n int, email string, username string")
    new = spark.createDataFrame([(1, "a@x", "anna"), (2, "b@x", "anna"), (3, "c@x", "carl"), (4, "c@x", "cora"), (5, "d@x", "carl")], "n int, email string, username string")
    keys = [("email", "Email already registered"), ("username", "Username already taken")]
    out = {r["n"]: r["error"] for r in relations.reject_duplicates(new, old, keys, ["n"]).collect()}
    assert out == {1: "Email already registered", 2: "Username already taken", 3: None, 4: "Email already registered", 5: "Username already taken"}


def test_update_and_delete_report_missing_keys(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    changes = spark.createDataFrame([(2, "z"), (9, "q")], "id int, name string")
    out, report = relations.update_where(base, changes, "id", "name")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "z")]
    assert {tuple(r) for r in report.collect()} == {(2, True), (9, False)}
    left, report = relations.delete_where(base, changes, "id")
    assert col(left, "id") == [1] and {tuple(r) for r in report.collect()} == {(2, True), (9, False)}


def test_replicate(spark):
    base = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    assert relations.replicate(base, 10).count() == 9
    assert relations.replicate(base, 2).count() == 0
    many = relations.replicate(base, 75_001).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("copy").alias("d"), F.max("copy").alias("top"))
    assert {tuple(r)[1:] for r in many.collect()} == {(25_000, 25_000, 25_000)}


# tracking ------------------------------------------------------------------


def test_phases(spark):
    cases = [
        (None, None, "provisioning"), ("queued", None, "provisioning"), ("waiting", None, "provisioning"), ("in_progress", None, "syncing"),
        ("completed", "success", "ready"), ("completed", "failure", "failed"), ("completed", None, "failed"), ("odd", None, "syncing"),
    ]
    df = spark.createDataFrame(cases, "s string, c string, want string")
    assert df.filter(tracking.run_phase(F.col("s"), F.col("c")) != F.col("want")).count() == 0


def test_diff(spark):
    schema = "id int, name string, status string, conclusion string"
    prev = spark.createDataFrame([(2, "build", "in_progress", None), (3, "lint", "in_progress", None), (4, "same", "queued", None), (5, "gone", "queued", None), (6, "e2e", "in_progress", None)], schema)
    curr = spark.createDataFrame([(1, "deploy", "in_progress", None), (2, "build", "completed", "success"), (3, "lint", "queued", None), (4, "same", "queued", None), (6, "e2e", "completed", "failure")], schema)
    out = {r["id"]: (r["line"], r["level"]) for r in tracking.diff_snapshots(prev, curr, ["id"]).collect()}
    assert out == {
        1: ("Job started: deploy (in_progress)", "info"), 2: ("Job build: success", "info"), 3: ("Job lint: queued", "info"), 6: ("Job e2e: failure", "error"),
    }


@pytest.mark.parametrize("late", [None, 90])
def test_correlate_bounds(spark, late):
    d = spark.createDataFrame([("m", 1, T0), ("m", 2, T0 + timedelta(seconds=200)), ("n", 3, T0)], "b string, dispatch_id long, ts timestamp")
    r = spark.createDataFrame([("m", 11, 5, T0 - timedelta(seconds=30)), ("m", 12, 2, T0 - timedelta(seconds=31)), ("m", 13, 4, T0 + timedelta(seconds=90)), ("m", 14, 3, T0 + timedelta(seconds=291))],
                              "b string, run_id long, listing_pos long, ts timestamp")
    out = {x["dispatch_id"]: x["run_id"] for x in tracking.correlate(d, r, ["b"], 30, late).collect()}
    assert out == ({1: 14, 2: 14, 3: None} if late is None else {1: 13, 2: None, 3: None})


# counters, alerts, probes --------------------------------------------------


def brute_rate(samples, range_s, step_s):
    out = {}
    last = max(t for t, _ in samples)
    for k in range(0, int(last // step_s) + range_s // step_s + 2):
        end = k * step_s
        w = [(t, v) for t, v in samples if end - range_s < t <= end]
        if len(w) < 2 or w[-1][0] == w[0][0]:
            continue
        inc = w[-1][1] - w[0][1] + sum(a for (_, a), (_, b) in zip(w, w[1:]) if b < a)
        sampled = w[-1][0] - w[0][0]
        gap = sampled / (len(w) - 1)
        start, stop = w[0][0] - (end - range_s), end - w[-1][0]
        start = gap / 2 if start >= 1.1 * gap else start
        stop = gap / 2 if stop >= 1.1 * gap else stop
        if inc > 0 and w[0][1] >= 0:
            start = min(start, sampled * w[0][1] / inc)
        out[end] = inc * (sampled + start + stop) / sampled / range_s
    return out


def test_rate_with_resets(spark):
    series = {
        "reset": [(10, 10.0), (20, 12.0), (30, 3.0), (100, 4.0), (119, 1.0), (120, 9.0), (121, 2.0)],
        "single": [(50, 1.0)],
        "gap": [(5, 1.0), (15, 2.0), (2000, 3.0), (2010, 1.0)],
    }
    df = spark.createDataFrame([(s, datetime(1970, 1, 1) + timedelta(seconds=t), v) for s, p in series.items() for t, v in p], "series string, ts timestamp, value double")
    got = {(r["series"], (r["tick"] - datetime(1970, 1, 1)).total_seconds()): r["rate"] for r in metrics.counter_rate(df, ["series"], 120, 30).collect()}
    want = {(s, float(t)): v for s, p in series.items() for t, v in brute_rate(p, 120, 30).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert metrics.counter_rate(df, ["series"], 1000, 1).count() > 1000


def test_alert_gap_resolves(spark):
    on = [(0, True), (1, True), (2, True), (3, True), (5, True), (6, True), (7, False), (8, True)]
    df = spark.createDataFrame([("s", t, a) for t, a in on], "s string, tick long, active boolean")
    states = slo.alert_states(df, ["s"], 1, 2)
    got = {r["tick"]: r["state"] for r in states.collect()}
    assert got == {0: "pending", 1: "pending", 2: "firing", 3: "firing", 4: "inactive", 5: "pending", 6: "pending", 7: "inactive", 8: "pending"}
    assert slo.alert_count(states, ["s"]).collect()[0]["alerts"] == 1


def test_many_newest_rows_of_a_hot_key(spark):
    from fleetlens.operators import tracking

    df = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 'hot' ELSE 'cold' END AS k", "id * 7919 % 5003 AS t")
    rows = [tuple(r) for r in df.collect()]
    for n in (3, 1500):
        want = sorted(r for k in ("hot", "cold") for r in sorted((x for x in rows if x[0] == k), key=lambda x: -x[1])[:n])
        assert sorted(tuple(r) for r in tracking.last_n(df, ["k"], ["t"], n).collect()) == want


def test_two_changes_of_a_key_need_an_order(spark):
    from pyspark.errors import SparkRuntimeException

    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    once = spark.createDataFrame([(1, "x"), (3, "z")], "k long, v string")
    assert {tuple(r) for r in relations.upsert(base, once, "k").collect()} == {(1, "x"), (2, "b"), (3, "z")}
    with pytest.raises(SparkRuntimeException, match="need an order: 1"):
        relations.upsert(base, once.union(once.limit(1)), "k").collect()


def test_a_silent_year_is_one_row(spark):
    year = 365 * 86400
    ticks = [("s", 0, True), ("s", 1, True), ("s", 2, True), ("s", year, False), ("s", 2 * year, True), ("t", 5, False), ("t", 9, False), ("u", 7, True)]
    df = spark.createDataFrame(ticks, "s string, tick long, active boolean")
    want = [
        ("s", 0, 1, "pending", 0), ("s", 2, 2, "firing", 0), ("s", 3, 2 * year - 1, "inactive", None),
        ("s", 2 * year, 2 * year, "pending", 2 * year), ("t", 5, 9, "inactive", None), ("u", 7, 7, "pending", 7),
    ]
    for limit in (10**9, 2):
        found = slo.alert_intervals(df, ["s"], 1, 2, limit)
        assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2]) == want
    at_once = slo.alert_intervals(df, ["s"], 1, 0).filter("s = 'u'").collect()
    assert [tuple(r) for r in at_once] == [("u", 7, 7, "firing", 7)]
    every = slo.interval_ticks(spark.createDataFrame([("s", 3, 30_002, "inactive", None)], found.schema), ["s"], 3)
    assert sorted(r["tick"] for r in every.collect()) == list(range(3, 30_003, 3))


@pytest.mark.parametrize("step, for_", [(1, 2), (5, 12), (2, 0)])
def test_alert_intervals_against_every_tick(spark, step, for_):
    import random

    rng = random.Random(step)
    ticks = [(k, step * t, rng.random() < 0.7) for k in "ab" for t in sorted(rng.sample(range(300), 160))]
    want = set()
    for k in "ab":
        mine = {t: a for n, t, a in ticks if n == k}
        since = None
        for t in range(min(mine), max(mine) + 1, step):
            active = mine.get(t, False)
            since = (t if since is None else since) if active else None
            want.add((k, t, "inactive" if not active else "firing" if t - since >= for_ else "pending"))
    df = spark.createDataFrame(ticks, "k string, tick long, active boolean")
    for limit in (10**9, 20):
        assert {tuple(r) for r in slo.alert_states(df, ["k"], step, for_, limit).select("k", "tick", "state").collect()} == want


def test_percentiles_of_a_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"), ((F.col("id") * 37) % 211).cast("double").alias("v"))
    plain = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("v", 0.95).alias("p")).collect()}
    for limit in (10**9, 50):
        got = {r["g"]: r["p"] for r in metrics.percentiles(df, ["g"], "v", {"p": 0.95}, limit).collect()}
        assert all(abs(got[g] - plain[g]) < 1e-9 for g in plain)


# cluster -------------------------------------------------------------------


def test_relabel(spark):
    P = "__meta_kubernetes_service_annotation_prometheus_io_"
    rules = [
        {"action": "keep", "source": [P + "scrape"], "regex": "true"},
        {"action": "replace", "source": ["__address__", P + "port"], "regex": r"(.+?)(?::\d+)?;(\d+)", "replacement": "$1:$2", "target": "__address__"},
        {"action": "labelmap", "regex": "__meta_label_(.+)"},
        {"action": "replace", "source": ["__meta_none"], "target": "gone"},
    ]
    targets = [
        (1, {"__address__": "10.0.0.1:8080", P + "scrape": "true", P + "port": "9113", "__meta_label_app": "web", "app": "old", "gone": "x"}),
        (2, {"__address__": "10.0.0.2:8080", P + "scrape": "true"}),
        (3, {"__address__": "10.0.0.3:8080", P + "scrape": "false"}),
    ]
    out = {r["i"]: r["labels"] for r in cluster.relabel(spark.createDataFrame(targets, "i int, labels map<string,string>"), rules).collect()}
    assert set(out) == {1, 2}
    assert out[1]["__address__"] == "10.0.0.1:9113" and out[2]["__address__"] == "10.0.0.2:8080"
    assert out[1]["app"] == "web" and out[1]["__meta_label_app"] == "web" and "gone" not in out[1]


def test_selectors(spark):
    sel = spark.createDataFrame([(1, {"a": "1", "b": "2"}, None), (2, {}, ["x"]), (3, {"a": "9"}, None), (4, {"a": "1"}, ["y"])], "selector_id int, match map<string,string>, namespaces array<string>")
    obj = spark.createDataFrame([(10, "x", {"a": "1", "b": "2"}), (11, "y", {"a": "1"}), (12, "x", {}), (13, "y", {"a": "1", "b": "3"})], "object_id int, namespace string, labels map<string,string>")
    got = {tuple(r) for r in cluster.match_selector(sel, obj).collect()}
    assert got == {(1, 10), (2, 10), (2, 12), (4, 11), (4, 13)}


@pytest.mark.parametrize("limit", [10**9, 20])
def test_selectors_over_hot_pairs_and_namespaces(spark, limit):
    """An empty selector over everything, and pairs and a namespace that most objects share."""
    import random

    rng = random.Random(6)
    objects = [(i, rng.choice(["big"] * 8 + ["small", "*"]), {"app": "web" if i % 10 else "db", "tier": str(i % 3), "own": str(i)}) for i in range(300)]
    objects.append((300, None, {"app": "web"}))
    selectors = [
        (1, {}, None), (2, {}, ["big"]), (3, {"app": "web"}, None), (4, {"app": "web", "tier": "1"}, ["small", "*", "small"]),
        (5, {"tier": "2"}, ["big", "none"]), (6, {"app": "web", "no": "1"}, None), (7, {}, []), (8, {"own": "7", "app": "web"}, None), (9, {}, ["*"]),
    ]
    want = {
        (s, o) for s, match, ns in selectors for o, n, labels in objects
        if (ns is None or n in ns) and all(labels.get(k) == v for k, v in match.items())
    }
    sel = spark.createDataFrame(selectors, "selector_id int, match map<string,string>, namespaces array<string>")
    obj = spark.createDataFrame(objects, "object_id int, namespace string, labels map<string,string>")
    found = cluster.match_selector(sel, obj, limit)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def serial_clashes(existing, new):
    """One registration after the other; rows are (id, a, b)."""
    held, out = [{}, {}], {}
    for i, *values in sorted(existing):
        for h, v in zip(held, values):
            h.setdefault(v, (0, i))
    for i, *values in sorted(new):
        clash = [(h[v], k) for k, (h, v) in enumerate(zip(held, values)) if v is not None and v in h]
        out[i] = "ab"[min(clash)[1]] if clash else None
        if not clash:
            for h, v in zip(held, values):
                h.setdefault(v, (1, i))
    return out


@pytest.mark.parametrize("whole", [10**6, 40, 6])
def test_clash_components(spark, whole):
    """Chains, stars and loose rows; components go to tasks whole, and those above the bound in rounds."""
    import random

    rng = random.Random(9)
    new = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(60)]  # a chain of clashes
    new += [(100 + i, "star", f"s{i}") for i in range(20)] + [(200 + i, f"x{rng.randrange(25)}", f"y{rng.randrange(25)}") for i in range(40)]
    new += [(300, None, None), (301, None, "b3"), (302, "only", None), (303, None, None)]
    existing = [(1, "a7", None), (2, "x3", "y4"), (3, None, "s4")]
    schema = "id long, a string, b string"
    out = relations.reject_duplicates(
        spark.createDataFrame(new, schema).repartition(5), spark.createDataFrame(existing, schema), [("a", "a"), ("b", "b")], ["id"], whole
    )
    assert {r["id"]: r["error"] for r in out.collect()} == serial_clashes(existing, new)


def test_components(spark):
    import random

    from fleetlens.operators.components import components

    rng = random.Random(4)
    path = list(range(400))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(500 + rng.randrange(30), 500 + rng.randrange(30)) for _ in range(20)] + [(900, 900 + i) for i in range(50)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_chain_of_clashes_takes_few_jobs(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("id", "concat('a', (id + 1) div 2) AS a", "concat('b', id div 2) AS b")
    none = spark.createDataFrame([], "id long, a string, b string")
    spark.sparkContext.setJobGroup("chain", "chain")
    out = relations.reject_duplicates(chain, none, [("a", "a"), ("b", "b")], ["id"])
    accepted = sorted(r["id"] for r in out.filter("error IS NULL").collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert accepted == list(range(0, n, 2)) and jobs <= 20


@pytest.mark.parametrize("limit", [10**9, 15])
def test_permissions_of_a_role_that_most_subjects_have(spark, limit):
    import random

    rng = random.Random(8)
    roles = [("view", [(["", "apps"], ["pods", "jobs"], ["get", "list"])]), ("admin", [(["*"], ["*"], ["*"])]), ("odd", [(["apps"], ["jobs"], ["*"]), ([""], ["pods"], ["watch"])])]
    bindings = [(f"s{i % 90}", rng.choice("xy"), rng.choice(["view"] * 8 + ["admin", "odd", None, "none"])) for i in range(150)]
    asked = [(f"s{rng.randrange(95)}", rng.choice("xy"), rng.choice(["", "apps"]), rng.choice(["pods", "jobs"]), rng.choice(["get", "watch"])) for _ in range(300)]
    rules = dict(roles)
    held = lambda have, want: "*" in have or want in have
    want = {
        q: any((q[0], q[1], r) in set(bindings) and any(held(g, q[2]) and held(o, q[3]) and held(v, q[4]) for g, o, v in rules.get(r, [])) for r in rules)
        for q in asked
    }
    roles = spark.createDataFrame(roles, "role string, rules array<struct<api_groups array<string>, resources array<string>, verbs array<string>>>")
    bound = spark.createDataFrame(bindings, "subject string, namespace string, role string")
    questions = spark.createDataFrame(asked, "subject string, namespace string, api_group string, resource string, verb string")
    got = cluster.can_i(questions, bound, roles, limit)
    assert {tuple(r)[:5]: r["allowed"] for r in got.collect()} == want and got.count() == len(want)
    grants = {(s, n, g, o, v) for s, n, r in bindings for gs, os, vs in rules.get(r, []) for g in gs for o in os for v in vs}
    assert sorted(tuple(r) for r in cluster.effective_permissions(bound, roles, limit).collect()) == sorted(grants)


def test_policies_only_add(spark):
    schema = "n int, ns string, direction string, pod_labels map<string,string>, peer_ns map<string,string>, peer_pod map<string,string>, peer_ns_name string, protocol string, port int"
    flows = [
        (1, "acme", "egress", {}, {"tenant": "zeta"}, {}, "zeta", "TCP", 22),  # the rule named deny in fact allows this
        (2, "acme", "ingress", {}, {"tenant": "zeta"}, {}, "zeta", "TCP", 22),
        (3, "acme", "ingress", {}, {"tenant": "acme"}, {}, "acme", "TCP", 22),
        (4, "acme", "egress", {}, {"name": "kube-system"}, {}, "kube-system", "UDP", 53),
        (5, "acme", "egress", {}, {"name": "kube-system"}, {}, "kube-system", "UDP", 54),
        (6, "acme", "ingress", {"app": "cicd"}, {}, {"cicd": "agent"}, "acme", "TCP", 8080),
        (7, "acme", "ingress", {"app": "cicd"}, {}, {"cicd": "agent"}, "other", "TCP", 8080),
        (8, "open", "ingress", {}, {}, {}, "other", "TCP", 1),
    ]
    out = cluster.policy_verdict(spark.createDataFrame(flows, schema), tenant_policies("acme"))
    assert {r["n"] for r in out.collect() if r["allowed"]} == {1, 3, 4, 6, 8}


def test_headers_and_nodes(spark):
    df = spark.createDataFrame([([("SUBJECT", "hi"), ("subject", "no")],), ([],)], "h array<struct<name: string, value: string>>")
    assert col(df.select(cluster.header("h", "Subject", "(No Subject)").alias("s")), "s") == ["hi", "(No Subject)"]
    nodes = spark.createDataFrame([({"GPU": 2.7, "accelerator_type:A": 1.0},), ({"CPU": 1.0},)], "resources map<string,double>")
    assert [(r["gpus"], r["device_ids"]) for r in cluster.node_resources(nodes).collect()] == [(2, ["A"]), (0, [])]


def test_null_container_lists_give_no_rows(spark):
    df = spark.createDataFrame([(1, [("a",)]), (2, None), (3, [])], "i int, items array<struct<name: string>>")
    assert col(cluster.explode_containers(df, "items"), "i") == [1]


# scalars, validation -------------------------------------------------------


def test_quantities(spark):
    df = spark.createDataFrame([("500m", 0.5), ("1", 1.0), ("512Mi", 536870912.0), ("1Gi", 1073741824.0), ("x", None), ("", None), (None, None)], "q string, want double")
    assert df.filter(~text.quantity(F.col("q")).eqNullSafe(F.col("want"))).count() == 0


def test_signature_parts_collide_unless_delimited(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "p string, t string")
    assert df.select(ids.job_signature("p", "t", F.lit("")).alias("s")).distinct().count() == 1
    assert df.select(ids.job_signature("p", "t", F.lit(""), delimited=True).alias("s")).distinct().count() == 2


def test_validate_all(spark):
    df = spark.createDataFrame([(" ", None, "x")], "a string, b string, c string")
    assert validate.validate_all(df, ["a", "b", "c"]).collect()[0]["error"] == "Missing required fields: a, b"


def test_limit_results(spark):
    df = spark.range(300)
    assert rows.limit_results(df, ["id"]).count() == 10
    for bad in (0, 101):
        with pytest.raises(ValueError):
            rows.limit_results(df, ["id"], bad)


# sources, prediction -------------------------------------------------------


def test_envelope_config(spark):
    good = '{"servers": {"mariadb-mcp-server": {"url": "http://mariadb-mcp:9001/sse", "type": "sse"}}}'
    env = lambda **kw: __import__("json").dumps({"job_id": "1", "payload": "", **kw})
    df = spark.createDataFrame([(env(payload=good),), (env(parameters={"config": good}),), (env(),), ("nope",), (env(payload="[]x"),)], "value string")
    out = queue.decode_envelope(df).collect()
    assert [r["config_source"] for r in out] == ["payload", "parameters", None, None, "payload"]
    assert [r["error"] for r in out] == [None, None, "no config found in payload or parameters", "failed to unmarshal job envelope", "failed to parse MCP config"]
    found = queue.resolve_server(queue.decode_envelope(df).limit(1), F.lit("mariadb-mcp-server")).collect()[0]
    assert found["server"]["url"].endswith("/sse") and found["error"] is None


def test_scrapes_from_a_text_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('# HELP x y\nusers_total 3.0\nhttp{code="200",path="/a,b"} 5 1700000000000\nbroken{\n')
    stream = files.ingest_scrapes(spark.readStream.text(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = {r["name"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(out) == {"users_total", "http"} and out["http"]["labels"] == {"code": "200", "path": "/a,b"} and out["http"]["value"] == 5.0


def test_report_file(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    files.write_report(df, str(tmp_path / "r"), ["k", "v"], "Title", "now")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r"), wholetext=False).collect()]
    assert set(lines) >= {"Title", "| a | 1 |", "| b | 2 |", "Total images found: 2"}


def test_large_tenant_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").otherwise(F.concat(F.lit("t"), F.col("id") % 5)).alias("org"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the fixture is tiny
    try:
        files.write_tenant_partitioned(df, str(tmp_path / "o"), "org", ["id"], rows_per_file=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "o" / "org=big").glob("*.parquet"))) > 2
    assert files.read_tenant(spark, str(tmp_path / "o"), "org", "big").count() == 900
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1000


def test_queue_keeps_order_per_tenant(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.col("id").cast("string").alias("value"), (-F.col("id")).alias("at"))
    queue.write_jobs(rows, str(tmp_path / "q"), order=["at"])
    out = spark.read.parquet(str(tmp_path / "q")).select("key", "value", F.spark_partition_id().alias("p"))
    assert out.groupBy("key").agg(F.count_distinct("p").alias("n")).filter("n > 1").isEmpty()
    for batch in (tmp_path / "q").glob("*.parquet"):
        seen = {}
        for r in spark.read.parquet(str(batch)).collect():
            assert int(r["value"]) < seen.get(r["key"], 10**9)
            seen[r["key"]] = int(r["value"])


def test_predict_batches(spark):
    class Model:
        def __call__(self, prompts):
            assert len(prompts) <= 32
            return [p.upper() for p in prompts]

    df = spark.range(200).select(F.when(F.col("id") != 5, F.concat(F.lit("p"), "id")).alias("item"))
    out = predict(df, "item", Model, "m", F.lit("2024-01-01"), concurrency=3)
    assert out.filter("generated_text = upper(item)").count() == 199 and out.filter("generated_text is null").count() == 1


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k string, id long, ts timestamp, ok boolean, value double")
    assert slo.incidents(empty, ["k"], ["ts", "id"]).count() == 0
    assert metrics.sessions(empty, ["k"], "ts", "id", 10).count() == 0
    assert metrics.percentiles(empty, ["k"], "value", {"p": 0.5}).count() == 0
    assert metrics.counter_rate(empty, ["k"], 60, 30).count() == 0
    from fleetlens.operators.intake import throttle

    assert throttle(empty, ["k"], "ts", "id", 1, 1).count() == 0


def test_a_models_task_keeps_rows_in_arrow(spark):
    """Only one call's prompts become Python objects, and the other columns pass unchanged."""
    calls = lambda: lambda prompts: [f"{len(prompts)} {max(map(len, prompts))}" for prompts in [prompts] for _ in prompts]
    df = spark.createDataFrame([(i, "x" * (i % 90 + 1) if i % 9 else None, [i]) for i in range(100)], "id long, item string, more array<long>").coalesce(1)
    out = predict(df, "item", calls, "m", F.lit("2024-01-01"))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 100 and all(r["more"] == [i] for i, r in got.items())
    assert {r["generated_text"].split()[0] for r in got.values() if r["item"]} == {"32", "24"}
    assert all(r["generated_text"] is None for r in got.values() if r["item"] is None)


@pytest.mark.parametrize("hot", [False, True])
def test_keys_are_looked_up_in_tasks_of_bounded_rows(spark, hot):
    """As many tasks as the rows need, also where one key, or null, holds most of the rows."""
    key = F.col("id") % 500
    if hot:
        key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(key)
    child = spark.range(6000).select(key.cast("long").alias("k"), "id", F.create_map(F.lit("a"), "id").alias("m"))
    parent = spark.range(0, 500, 2).unionAll(spark.range(7, 8)).unionAll(spark.range(7, 8)).withColumnRenamed("id", "pk")
    known = {*range(0, 500, 2), 7}
    ok, orphan = relations.enforce_fk(child, parent, "k", "pk", rows_per_task=200)
    rows = [(r["k"], r["id"]) for r in child.collect()]
    got = [sorted(r["id"] for r in df.collect()) for df in (ok, orphan)]
    assert got == [sorted(i for k, i in rows if (k in known) == met) for met in (True, False)]
    assert orphan.columns == child.columns
    sizes = orphan.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert orphan.rdd.getNumPartitions() == 30 and sizes < 600
    parents, left = relations.delete_cascade(parent, child, parent.filter("pk < 100"), "pk", "k", rows_per_task=200)
    assert parents.count() == 200
    assert sorted(r["id"] for r in left.collect()) == sorted(i for k, i in rows if k is None or k not in {p for p in known if p < 100})


def test_queue_partitions_share_out_the_messages(spark, tmp_path):
    path = str(tmp_path / "q")
    rows = spark.range(1000).select(F.lit("hot").alias("key"), F.col("id").cast("string").alias("value"))
    queue.write_jobs(rows, path, per_file=100, partitions=3)
    read = [spark.read.schema("key string, value string").parquet(queue.partition_path(path, p)) for p in range(3)]
    sizes = [df.count() for df in read]
    assert sum(sizes) == 1000 and min(sizes) > 200
    assert reduce(lambda a, b: a.unionByName(b), read).distinct().count() == 1000
    # a partition without messages is an empty stream
    none = queue.read_jobs_stream(spark, queue.partition_path(path, 99), fetch_limit=200, per_file=100)
    assert run_to_end(none, "none").count() == 0
