"""Joins and nesting."""

from pyspark.sql import functions as F

from fleetlens.operators import cluster, quotas, relations, tracking
from fleetlens.plans.registry import query
from fleetlens.sources import queue

@query(
    "j1_nest",
    """WITH p AS (SELECT c_nationkey, c_custkey, c_name, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 25 AS page FROM customer),
    g AS (SELECT c_nationkey, page, CAST(to_json(list({'c_custkey': c_custkey, 'c_name': c_name} ORDER BY c_custkey)) AS VARCHAR) AS employees FROM p GROUP BY ALL)
    SELECT n_nationkey, n_name, coalesce(page, 0) AS page, coalesce(employees, '[]') AS employees FROM nation LEFT JOIN g ON n_nationkey = c_nationkey""",
)
def j1(t):
    out = relations.nest(
        t.nation.select("n_nationkey", "n_name"), t.customer, "n_nationkey", "c_nationkey", "employees",
        ["c_custkey"], ["c_custkey", "c_name"], page_rows=25, rows_per_task=t.rows_per_task,
    )
    return out.withColumn("employees", F.to_json("employees"))


@query(
    "j2_nest_two_levels",
    """WITH p AS (SELECT c_nationkey, c_custkey, c_name, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 1000 AS part FROM customer),
    g AS (SELECT c_nationkey, part, list({'c_custkey': c_custkey, 'c_name': c_name} ORDER BY c_custkey) AS employees FROM p GROUP BY ALL),
    d AS (SELECT n_regionkey, n_nationkey, n_name, coalesce(part, 0) AS part, coalesce(employees, []) AS employees FROM nation LEFT JOIN g ON n_nationkey = c_nationkey),
    o AS (SELECT *, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, part) - 1) // 1000 AS page FROM d)
    SELECT r_regionkey, r_name, page, CAST(to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name, 'part': part, 'employees': employees} ORDER BY n_nationkey, part)) AS VARCHAR) AS departments
    FROM region JOIN o ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name, page""",
)
def j2(t):
    out = relations.nest2(
        t.region, t.nation, t.customer, "r_regionkey", "n_regionkey", "n_nationkey", "c_nationkey",
        ("departments", "employees"), ["n_nationkey", "n_name"], ["c_custkey", "c_name"],
    )
    return out.withColumn("departments", F.to_json("departments"))


@query(
    "j3_nest_departments",
    """SELECT r_regionkey, r_name, CAST(0 AS BIGINT) AS page, CAST(to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey)) AS VARCHAR) AS departments
    FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL""",
)
def j3(t):
    out = relations.nest(t.region, t.nation, "r_regionkey", "n_regionkey", "departments", ["n_nationkey"], ["n_nationkey", "n_name"])
    return out.withColumn("departments", F.to_json("departments"))


@query(
    "j4_nest_skip_level",
    """WITH p AS (SELECT n_regionkey, c_custkey, c_name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) - 1) // 100 AS page FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT r_regionkey, r_name, page, CAST(to_json(list({'c_custkey': c_custkey, 'c_name': c_name} ORDER BY c_custkey)) AS VARCHAR) AS employees
    FROM region JOIN p ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name, page""",
)
def j4(t):
    staff = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey", "c_name")
    out = relations.nest(
        t.region, staff, "r_regionkey", "n_regionkey", "employees", ["c_custkey"], ["c_custkey", "c_name"], page_rows=100,
        rows_per_task=t.rows_per_task,
    )
    return out.withColumn("employees", F.to_json("employees"))


BIG_ORDERS = "SELECT * FROM orders WHERE o_totalprice > 100000"


@query(
    "j5_enforce_fk",
    f"""SELECT CASE WHEN o_orderkey IS NULL THEN 'orphan' ELSE 'accepted' END AS verdict, l_orderkey, l_linenumber, l_partkey, l_quantity
    FROM lineitem LEFT JOIN ({BIG_ORDERS}) ON o_orderkey = l_orderkey""",
)
def j5(t):
    parents = t.orders.filter("o_totalprice > 100000").select("o_orderkey")
    ok, orphan = relations.enforce_fk(t.lineitem, parents, "l_orderkey", "o_orderkey")
    rows = lambda df, v: df.select(F.lit(v).alias("verdict"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rows(ok, "accepted").unionByName(rows(orphan, "orphan"))


@query(
    "j6_delete_cascade",
    f"""SELECT 'orders' AS tab, o_orderkey AS order_key, NULL::BIGINT AS line, o_totalprice AS price FROM orders WHERE NOT o_totalprice > 100000
    UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM ({BIG_ORDERS}))""",
)
def j6(t):
    gone = t.orders.filter("o_totalprice > 100000").select("o_orderkey")
    parents, children = relations.delete_cascade(t.orders, t.lineitem, gone, "o_orderkey", "l_orderkey")
    rows = lambda df, tab, key, line, price: df.select(
        F.lit(tab).alias("tab"), F.col(key).alias("order_key"), line.cast("long").alias("line"), F.col(price).alias("price")
    )
    return rows(parents, "orders", "o_orderkey", F.lit(None), "o_totalprice").unionByName(
        rows(children, "lineitem", "l_orderkey", F.col("l_linenumber"), "l_extendedprice")
    )


@query(
    "j7_reject_duplicates",
    """WITH RECURSIVE old AS (SELECT o_orderkey AS id, o_custkey AS email, o_orderdate AS username FROM orders WHERE o_orderstatus = 'F'),
      r AS (SELECT 0 AS turn, o_orderkey AS id, o_custkey AS email, o_orderdate AS username,
          CASE WHEN o_custkey IN (SELECT email FROM old) OR o_orderdate IN (SELECT username FROM old) THEN 'refused' ELSE 'open' END AS state
        FROM orders WHERE o_orderstatus = 'O'
        UNION ALL SELECT turn + 1, id, email, username, CASE WHEN state <> 'open' THEN state WHEN e_held OR u_held THEN 'refused' WHEN id = e_first AND id = u_first THEN 'accepted' ELSE 'open' END
        FROM (SELECT *, bool_or(state = 'accepted') OVER (PARTITION BY email) AS e_held, bool_or(state = 'accepted') OVER (PARTITION BY username) AS u_held,
            min(CASE WHEN state = 'open' THEN id END) OVER (PARTITION BY email) AS e_first, min(CASE WHEN state = 'open' THEN id END) OVER (PARTITION BY username) AS u_first,
            bool_or(state = 'open') OVER () AS more FROM r) WHERE more),
      f AS (SELECT * FROM r WHERE turn = (SELECT max(turn) FROM r)),
      held AS (SELECT 0 AS s, id, email, username FROM old UNION ALL SELECT 1, id, email, username FROM f WHERE state = 'accepted'),
      e AS (SELECT email, min((s, id)) AS at FROM held GROUP BY 1), u AS (SELECT username, min((s, id)) AS at FROM held GROUP BY 1),
      c AS (SELECT f.id, CASE WHEN e.at < (1, f.id) THEN e.at END AS e_at, CASE WHEN u.at < (1, f.id) THEN u.at END AS u_at FROM f LEFT JOIN e USING (email) LEFT JOIN u USING (username))
    SELECT id AS o_orderkey, CASE WHEN e_at IS NOT NULL AND (u_at IS NULL OR e_at <= u_at) THEN 'Email already registered' WHEN u_at IS NOT NULL THEN 'Username already taken' END AS error FROM c""",
)
def j7(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("email"), F.col("o_orderdate").alias("username"), "o_orderstatus")
    new = rows.filter("o_orderstatus = 'O'").select("o_orderkey", "email", "username")
    old = rows.filter("o_orderstatus = 'F'").select("o_orderkey", "email", "username")
    keys = [("email", "Email already registered"), ("username", "Username already taken")]
    return relations.reject_duplicates(new, old, keys, ["o_orderkey"]).select("o_orderkey", "error")


@query(
    "j8_with_owner",
    """SELECT o_orderkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def j8(t):
    out = relations.with_owner(t.orders.select("o_orderkey", "o_custkey"), t.customer, "o_custkey", "c_custkey", ["c_custkey", "c_name"])
    return out.select("o_orderkey", F.to_json("owner").alias("owner"))


@query(
    "j8_with_items",
    """SELECT c_custkey, CAST(0 AS BIGINT) AS page, coalesce(items, '[]') AS items FROM customer LEFT JOIN
    (SELECT o_custkey, CAST(to_json(list({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus} ORDER BY o_orderkey)) AS VARCHAR) AS items FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def j8b(t):
    out = relations.with_items(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return out.withColumn("items", F.to_json("items"))


@query(
    "j9_with_quota",
    """SELECT c_custkey, tier, cpu AS requests_cpu, mem * 1073741824.0 AS requests_memory, CASE WHEN cpu IS NULL THEN 'unknown plan tier: ' || tier END AS error
    FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'FREE' WHEN 'FURNITURE' THEN 'STARTER' WHEN 'MACHINERY' THEN 'PRO' WHEN 'AUTOMOBILE' THEN 'ENTERPRISE' ELSE 'UNSPECIFIED' END AS tier FROM customer)
    LEFT JOIN (VALUES ('FREE', 2.0::DOUBLE, 4.0::DOUBLE), ('STARTER', 5, 10), ('PRO', 20, 40), ('ENTERPRISE', 100, 200)) v(name, cpu, mem) ON tier = name""",
)
def j9(t):
    tier = F.expr(
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'FREE' WHEN 'FURNITURE' THEN 'STARTER' WHEN 'MACHINERY' THEN 'PRO' WHEN 'AUTOMOBILE' THEN 'ENTERPRISE' ELSE 'UNSPECIFIED' END"
    )
    out = quotas.with_quota(t.customer.select("c_custkey", tier.alias("tier")), "tier")
    return out.select("c_custkey", "tier", "requests_cpu", "requests_memory", "error")


def dispatches(t):
    e = t.events.withColumnRenamed("event_id", "id")
    d = e.filter("event_type = 'signup'").select("user_id", F.col("id").alias("dispatch_id"), "ts")
    r = e.filter("event_type = 'purchase'").select("user_id", F.col("id").alias("run_id"), F.col("id").alias("listing_pos"), "ts")
    return d, r


@query(
    "j10_correlate",
    """SELECT d.user_id, d.event_id AS dispatch_id, d.ts, min(r.event_id) AS run_id FROM events d
    LEFT JOIN events r ON r.event_type = 'purchase' AND r.user_id = d.user_id AND r.ts >= d.ts - INTERVAL 30 SECOND WHERE d.event_type = 'signup' GROUP BY ALL""",
)
def j10(t):
    return tracking.correlate(*dispatches(t), ["user_id"], 30, rows_per_task=t.rows_per_task)


@query(
    "j10_correlate_within",
    """SELECT d.user_id, d.event_id AS dispatch_id, d.ts, min(r.event_id) AS run_id FROM events d
    LEFT JOIN events r ON r.event_type = 'purchase' AND r.user_id = d.user_id AND r.ts BETWEEN d.ts - INTERVAL 30 SECOND AND d.ts + INTERVAL 6 HOUR WHERE d.event_type = 'signup' GROUP BY ALL""",
)
def j10b(t):
    return tracking.correlate(*dispatches(t), ["user_id"], 30, late=6 * 3600)


@query(
    "j10_correlate_suffix",
    """WITH d AS (SELECT event_id AS dispatch_id, ts, user_id % 10 || '.yml' AS workflow FROM events WHERE event_type = 'signup'),
      r AS (SELECT event_id AS run_id, ts, '.github/workflows/wf-' || user_id || '.yml' AS path FROM events WHERE event_type = 'purchase')
    SELECT workflow, dispatch_id, d.ts, min(run_id) AS run_id FROM d LEFT JOIN r ON ends_with(path, workflow) AND r.ts >= d.ts - INTERVAL 30 SECOND GROUP BY ALL""",
)
def j10s(t):
    d, r = dispatches(t)
    d = d.withColumn("workflow", F.concat((F.col("user_id") % 10).cast("string"), F.lit(".yml")))
    r = r.withColumn("path", F.concat(F.lit(".github/workflows/wf-"), F.col("user_id").cast("string"), F.lit(".yml")))
    return tracking.correlate(d, tracking.suffix_keys(r, "path", d, "workflow"), ["workflow"], rows_per_task=t.rows_per_task)


@query(
    "j11_change_events",
    """WITH p AS (SELECT user_id, event_id, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
    SELECT user_id, event_id, line, CASE WHEN contains(lower(line), 'fail') THEN 'error' ELSE 'info' END AS level FROM
    (SELECT *, CASE WHEN old IS NULL THEN 'Job started: fail-' || user_id || ' (' || status || ')' ELSE 'Job fail-' || user_id || ': ' || status END AS line FROM p WHERE old IS DISTINCT FROM status)""",
)
def j11(t):
    polls = t.events.select(
        "user_id", "event_id", "ts", F.col("event_type").alias("status"), F.lit(None).cast("string").alias("conclusion"),
        F.concat(F.lit("fail-"), F.col("user_id")).alias("name"),
    )
    return tracking.change_events(polls, ["user_id"], ["ts", "event_id"], t.rows_per_task).select("user_id", "event_id", "line", "level")


@query(
    "j11_run_created",
    """WITH p AS (SELECT user_id, event_id, ts, (CAST(props->>'$.k' AS INT) // 30)::BIGINT AS run_id FROM events WHERE event_type <> 'signup'),
      n AS (SELECT *, lag(run_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM p WHERE run_id <> 0)
    SELECT user_id, event_id, 'GitHub Actions run #' || run_id || ' created' AS line, 'info' AS level FROM n WHERE run_id IS DISTINCT FROM old""",
)
def j11c(t):
    run = F.when(F.col("event_type") != "signup", F.floor(F.get_json_object("props", "$.k").cast("int") / 30))
    polls = t.events.select("user_id", "event_id", "ts", run.alias("run_id"))
    out = tracking.run_created(polls, ["user_id"], ["ts", "event_id"], "run_id", t.rows_per_task)
    return out.select("user_id", "event_id", "line", "level")


@query(
    "j11_diff_snapshots",
    """WITH o AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS c FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
      n AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS c FROM orders GROUP BY 1)
    SELECT id, CASE WHEN o_status IS NULL THEN 'Job started: job (' || status || ')' ELSE 'Job job: ' || status END AS line, 'info' AS level
    FROM (SELECT n.*, o.status AS o_status, o.c AS o_c FROM n LEFT JOIN o USING (id)) WHERE o_status IS NULL OR o_status <> status OR o_c <> c""",
)
def j11b(t):
    jobs = t.orders.select(
        F.col("o_custkey").alias("id"), "o_orderkey", "o_orderdate", F.lit("").alias("name"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("conclusion"),
    )
    now = tracking.latest(jobs, ["id"], ["o_orderkey"])
    before = tracking.latest(jobs.filter("o_orderdate < '1999-01-01'"), ["id"], ["o_orderkey"])
    return tracking.diff_snapshots(before, now, ["id"]).select("id", "line", "level")


@query(
    "j12_resolve_user",
    """SELECT o_orderkey, CASE WHEN c.c_custkey IS NOT NULL AND o_orderpriority <> '5-LOW' THEN c.c_custkey END AS resolved_id,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'Invalid email format: c' || o_custkey WHEN c.c_custkey IS NULL THEN 'Slack user not found for email: c' || o_custkey || '@example.com' END AS reason
    FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON o_custkey = c.c_custkey""",
)
def j12(t):
    email = F.concat(F.lit("c"), F.col("o_custkey"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("@example.com"))
    people = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com")).alias("email"))
    return relations.resolve_user(t.orders.select("o_orderkey", email.alias("author")), people, "author").select("o_orderkey", "resolved_id", "reason")


@query(
    "j13_resolve_server",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'http://host' || user_id || '/sse' END AS url,
      CASE WHEN event_type IN ('error', 'signup') THEN 'server ' || event_type || ' not found in configuration'
           WHEN event_type = 'view' THEN 'unsupported server type: stdio' WHEN event_type = 'purchase' THEN 'server purchase not found in configuration' END AS error FROM events""",
)
def j13(t):
    entry = lambda kind: F.struct(F.concat(F.lit("http://host"), F.col("user_id"), F.lit("/sse")).alias("url"), F.lit(kind).alias("type"))
    config = F.struct(F.create_map(F.lit("click"), entry("sse"), F.lit("view"), entry("stdio")).alias("servers"))
    out = queue.resolve_server(t.events.select("event_id", "event_type", config.alias("config")), F.col("event_type"))
    return out.select("event_id", F.col("server.url").alias("url"), "error")


@query(
    "j14_match_selector",
    """SELECT n_nationkey AS selector_id, c_custkey AS object_id FROM nation JOIN customer ON c_nationkey = n_nationkey
    WHERE n_regionkey = 0 AND c_mktsegment = 'BUILDING' OR n_regionkey = 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY') OR n_regionkey > 1 AND c_mktsegment = 'FURNITURE'""",
)
def j14(t):
    nation_pair = lambda *more: F.create_map(F.lit("nation"), F.col("n_nationkey").cast("string"), *more)
    match = F.when(F.col("n_regionkey") == 0, nation_pair(F.lit("segment"), F.lit("BUILDING"))).when(
        F.col("n_regionkey") == 1, nation_pair()
    ).otherwise(nation_pair(F.lit("segment"), F.lit("FURNITURE")))
    ns = F.when(F.col("n_regionkey") == 1, F.array(F.lit("BUILDING"), F.lit("MACHINERY")))
    selectors = t.nation.select(F.col("n_nationkey").alias("selector_id"), match.alias("match"), ns.alias("namespaces"))
    labels = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))
    objects = t.customer.select(F.col("c_custkey").alias("object_id"), F.col("c_mktsegment").alias("namespace"), labels.alias("labels"))
    return cluster.match_selector(selectors, objects)


# fixed values: labels, ports and operators of the tenant policies
def tenant_policies(name):
    """The tenant isolation set: own tenant, shared services, web egress, other tenants, agents."""
    mine = {"ns": {"labels": {"tenant": name}}}
    kube = {"ns": {"labels": {"name": "kube-system"}}}
    return [
        {"namespace": name, "direction": "ingress", "allow": [{"peers": [mine]}]},
        {"namespace": name, "direction": "egress", "allow": [{"peers": [mine]}, {"peers": [{"ns": {"labels": {"common-services": "true"}}}]}]},
        {"namespace": name, "direction": "ingress", "allow": [{"peers": [mine]}, {"peers": [{"ns": {"labels": {"app.kubernetes.io/name": "ingress-nginx"}}}, kube]}]},
        {
            "namespace": name, "direction": "egress",
            "allow": [
                {"peers": [mine]},
                {"peers": [kube], "ports": [("UDP", 53)]},
                {"peers": [{"ns": {}}], "ports": [("TCP", 443), ("TCP", 80)]},
                {"peers": [{"ns": {"expressions": [{"key": "tenant", "operator": "Exists"}, {"key": "tenant", "operator": "NotIn", "values": [name]}]}}]},
            ],
        },
        {
            "namespace": name, "direction": "ingress", "pods": {"labels": {"app": "cicd"}},
            "allow": [{"peers": [{"pods": {"labels": {"cicd": "agent"}}}], "ports": [("TCP", 50000), ("TCP", 8080)]}],
        },
    ]


@query(
    "j15_policy_verdict",
    """SELECT event_id, CASE WHEN ns <> 'acme' THEN true
      WHEN direction = 'egress' THEN tenant IS NOT NULL OR port IN (80, 443)
      ELSE coalesce(tenant = 'acme', false) END AS allowed
    FROM (SELECT event_id, CASE WHEN user_id < 100 THEN 'acme' ELSE 'open' END AS ns, CASE WHEN event_type IN ('click', 'view') THEN 'egress' ELSE 'ingress' END AS direction,
      CASE WHEN CAST(props->>'$.k' AS INT) < 30 THEN 'acme' WHEN CAST(props->>'$.k' AS INT) < 60 THEN 'zeta' END AS tenant,
      CASE WHEN value > 50 THEN 443 ELSE 22 END AS port FROM events)""",
)
def j15(t):
    k = F.get_json_object("props", "$.k").cast("int")
    tenant = F.when(k < 30, "acme").when(k < 60, "zeta")
    flows = t.events.select(
        "event_id",
        F.when(F.col("user_id") < 100, "acme").otherwise("open").alias("ns"),
        F.when(F.col("event_type").isin("click", "view"), "egress").otherwise("ingress").alias("direction"),
        F.create_map(F.lit("app"), F.lit("web")).alias("pod_labels"),
        F.when(tenant.isNotNull(), F.create_map(F.lit("tenant"), tenant)).otherwise(F.create_map(F.lit("team"), F.lit("x"))).alias("peer_ns"),
        F.create_map(F.lit("app"), F.lit("web")).alias("peer_pod"),
        F.coalesce(tenant, F.lit("none")).alias("peer_ns_name"),
        F.lit("TCP").alias("protocol"),
        F.when(F.col("value") > 50, 443).otherwise(22).alias("port"),
    )
    return cluster.policy_verdict(flows, tenant_policies("acme")).select("event_id", "allowed")


# fixed values: the rules of the two tenant roles
ROLE_RULES = [
    ("tenant-user", [
        (["", "apps", "batch"], ["pods", "services", "deployments", "jobs"], ["get", "list", "watch", "create", "update", "patch"]),
        (["networking.k8s.io"], ["ingresses"], ["get", "list", "watch"]),
        ([""], ["configmaps"], ["get", "list", "watch", "create", "update", "patch"]),
    ]),
    ("tenant-admin", [(["*"], ["*"], ["*"])]),
]


def rbac(t):
    roles = t.spark.createDataFrame(ROLE_RULES, "role string, rules array<struct<api_groups: array<string>, resources: array<string>, verbs: array<string>>>")
    role = F.when(F.col("c_mktsegment") == "MACHINERY", "tenant-admin").otherwise("tenant-user")
    bindings = t.customer.filter("c_mktsegment IN ('MACHINERY', 'BUILDING')").select(
        F.col("c_name").alias("subject"), F.concat(F.lit("tenant-"), F.col("c_nationkey")).alias("namespace"), role.alias("role")
    )
    return bindings, roles


@query(
    "j16_effective_permissions",
    """WITH b AS (SELECT c_name AS subject, 'tenant-' || c_nationkey AS namespace, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')),
    g AS (SELECT g, r, v FROM (SELECT unnest(['', 'apps', 'batch']) AS g), (SELECT unnest(['pods', 'services', 'deployments', 'jobs']) AS r), (SELECT unnest(['get', 'list', 'watch', 'create', 'update', 'patch']) AS v)
      UNION SELECT 'networking.k8s.io', 'ingresses', unnest(['get', 'list', 'watch']) UNION SELECT '', 'configmaps', unnest(['get', 'list', 'watch', 'create', 'update', 'patch']))
    SELECT subject, namespace, g AS api_group, r AS resource, v AS verb FROM b, g WHERE m = 'BUILDING' UNION ALL SELECT subject, namespace, '*', '*', '*' FROM b WHERE m = 'MACHINERY'""",
)
def j16(t):
    return cluster.effective_permissions(*rbac(t))


@query(
    "j16_can_i",
    """SELECT c_name AS subject, 'tenant-' || c_nationkey AS namespace, 'apps' AS api_group, 'pods' AS resource, verb,
      c_mktsegment = 'MACHINERY' OR c_mktsegment = 'BUILDING' AND verb = 'get' AS allowed FROM customer, (SELECT unnest(['get', 'delete']) AS verb)""",
)
def j16b(t):
    questions = t.customer.select(
        F.col("c_name").alias("subject"), F.concat(F.lit("tenant-"), F.col("c_nationkey")).alias("namespace"),
        F.lit("apps").alias("api_group"), F.lit("pods").alias("resource"), F.explode(F.array(F.lit("get"), F.lit("delete"))).alias("verb"),
    )
    return cluster.can_i(questions, *rbac(t))


SPANS = """(SELECT o_orderkey AS trace_id, 'o' || o_orderkey AS span_id, NULL AS parent_id, o_orderpriority AS name, o_orderdate AS s, o_orderdate AS e FROM orders
  UNION ALL SELECT l_orderkey, 'l-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, 'o' || l_orderkey, 'line-' || l_linenumber, o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("j17_span_tree", f"SELECT c.trace_id, c.span_id, p.name AS parent_name, p.span_id IS NULL AS is_root FROM {SPANS} c LEFT JOIN {SPANS} p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id")
def j17(t):
    from fleetlens.operators.metrics import span_tree

    return span_tree(t.spans).select("trace_id", "span_id", F.col("parent.name").alias("parent_name"), F.col("parent").isNull().alias("is_root"))


@query(
    "j18_header",
    """SELECT page_id, coalesce(nullif(regexp_extract(url, '[?]([^#]*)', 1), ''), '(No Subject)') AS subject, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), '(Unknown Sender)') AS sender FROM pages""",
)
def j18(t):
    pair = lambda name, pattern: F.struct(F.lit(name).alias("name"), F.nullif(F.regexp_extract("url", pattern, 1), F.lit("")).alias("value"))
    headers = t.pages.select("page_id", F.array(pair("SUBJECT", "[?]([^#]*)"), pair("From", "#(.*)$")).alias("headers"))
    return headers.select(
        "page_id", cluster.header("headers", "Subject", "(No Subject)").alias("subject"), cluster.header("headers", "from", "(Unknown Sender)").alias("sender")
    )
