"""Filters, validation, routing, ordering and paging."""

from pyspark.sql import functions as F

from fleetlens.operators import cluster, rows, tracking, validate
from fleetlens.plans.registry import query

RUN = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'queued' WHEN '3-MEDIUM' THEN 'in_progress'
  WHEN '4-NOT SPECIFIED' THEN 'completed' ELSE 'unknown' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failure' WHEN 'O' THEN '' END AS conclusion FROM orders"""


def runs(t):
    return t.spark.sql(RUN.replace("FROM orders", "FROM {o}"), o=t.orders)


@query("f1_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name = 'Customer#000000042' ORDER BY c_custkey LIMIT 1")
def f1(t):
    return rows.lookup(t.customer, "c_name", "Customer#000000042", "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


@query(
    "f1_lookup_many",
    """SELECT k AS o_custkey, o_orderkey IS NOT NULL AS found, o_orderkey FROM (SELECT c_custkey AS k FROM customer)
    LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = k""",
)
def f1b(t):
    wanted = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return rows.lookup_many(t.orders.select("o_custkey", "o_orderkey"), wanted, "o_custkey", "o_orderkey")


@query("f2_filter_by", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def f2(t):
    return rows.filter_by(t.nation, n_regionkey=2).select("n_nationkey", "n_name")


@query(
    "f3_list_page",
    """WITH m AS (SELECT * FROM orders WHERE o_orderstatus = 'O'),
      p AS (SELECT o_orderkey, o_custkey FROM m WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50)
    SELECT o_orderkey, o_custkey, (SELECT count(*) FROM m) AS total_count, (SELECT max(o_orderkey) FROM p) AS next_token FROM p""",
)
def f3(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return rows.list_page(orders, "o_orderkey", 50, 500, F.col("o_orderstatus") == "O").drop("o_orderstatus")


@query(
    "f4_match_labels",
    """SELECT event_id, event_type FROM events WHERE regexp_full_match(event_type, '(pur|vi).*') AND props->>'$.k' = '7'""",
)
def f4(t):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    return rows.match_labels(e, {"k": "7"}, {"event_type": "(pur|vi).*"}).select("event_id", "event_type")


@query("f5_not_ready", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def f5(t):
    return rows.not_ready(t.orders, "o_orderstatus", ["F", "P"]).select("o_orderkey", "o_orderstatus")


@query("f6_active", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_type = 'ECONOMY'")
def f6(t):
    return rows.active_workflows(t.part, "p_type", ["p_partkey", "p_name", "p_brand"], "ECONOMY")


@query("f7_public_view", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def f7(t):
    return rows.public_view(t.customer, ["c_acctbal"])


@query(
    "f8_run_phase",
    f"""SELECT o_orderkey, CASE WHEN status IS NULL OR status IN ('queued', 'waiting', 'requested', 'pending') THEN 'provisioning'
      WHEN status = 'in_progress' THEN 'syncing' WHEN status = 'completed' AND conclusion = 'success' THEN 'ready'
      WHEN status = 'completed' THEN 'failed' ELSE 'syncing' END AS phase FROM ({RUN})""",
)
def f8(t):
    return runs(t).select("o_orderkey", tracking.run_phase(F.col("status"), F.col("conclusion")).alias("phase"))


@query(
    "f9_run_message",
    f"""SELECT o_orderkey, CASE WHEN status IN ('queued', 'waiting', 'requested', 'pending') THEN 'Workflow run queued on GitHub Actions'
      WHEN status = 'in_progress' THEN 'Workflow run in progress'
      WHEN status = 'completed' THEN CASE conclusion WHEN 'success' THEN 'GitHub Actions workflow completed successfully'
        WHEN 'failure' THEN 'GitHub Actions workflow failed' WHEN 'cancelled' THEN 'GitHub Actions workflow was cancelled'
        ELSE 'GitHub Actions workflow completed (' || coalesce(nullif(conclusion, ''), 'unknown') || ')' END
      ELSE 'Polling GitHub Actions' END AS message FROM ({RUN})""",
)
def f9(t):
    return runs(t).select("o_orderkey", tracking.run_message(F.col("status"), F.col("conclusion")).alias("message"))


@query(
    "f10_validate_first",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 5000 THEN 'price too low' WHEN o_orderstatus = 'P' THEN 'still pending'
      WHEN o_orderpriority = '5-LOW' THEN 'low priority' END AS error FROM orders""",
)
def f10(t):
    rules = [
        (F.col("o_totalprice") < 5000, "price too low"),
        (F.col("o_orderstatus") == "P", "still pending"),
        (F.col("o_orderpriority") == "5-LOW", "low priority"),
    ]
    return validate.validate_first(t.orders, rules).select("o_orderkey", "error")


PAGE_FIELDS = """SELECT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment, ' ' AS blank FROM pages"""


@query(
    "f11_validate_all",
    f"""SELECT page_id, array_to_string(m, ',') AS missing,
      CASE WHEN len(m) > 0 THEN 'Missing required fields: ' || array_to_string(m, ', ') END AS error
    FROM (SELECT page_id, list_filter([CASE WHEN trim(query) = '' THEN 'query' END, CASE WHEN trim(fragment) = '' THEN 'fragment' END, 'blank'], lambda x: x IS NOT NULL) AS m
          FROM ({PAGE_FIELDS}))""",
)
def f11(t):
    fields = t.pages.select(
        "page_id",
        F.regexp_extract("url", "[?]([^#]*)", 1).alias("query"),
        F.regexp_extract("url", "#(.*)$", 1).alias("fragment"),
        F.lit(" ").alias("blank"),
    )
    out = validate.validate_all(fields, ["query", "fragment", "blank"])
    return out.select("page_id", F.array_join("missing_fields", ",").alias("missing"), "error")


@query(
    "f12_bounds",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'c_acctbal must be at least 0' WHEN c_acctbal > 9000 THEN 'c_acctbal must be at most 9000'
      WHEN length(c_mktsegment) < 9 THEN 'c_mktsegment is shorter than 9' WHEN length(c_mktsegment) > 9 THEN 'c_mktsegment is longer than 9' END AS error FROM customer""",
)
def f12(t):
    rules = validate.bounds_rules({"c_acctbal": (0, 9000)}) + validate.length_rules({"c_mktsegment": (9, 9)})
    return validate.validate_first(t.customer, rules).select("c_custkey", "error")


@query(
    "f13_password",
    r"""SELECT doc_id, CASE WHEN length(text) < 8 THEN 'String should have at least 8 characters'
      WHEN length(text) > 100 THEN 'String should have at most 100 characters'
      WHEN NOT regexp_matches(text, '\p{Nd}') THEN 'Password must contain at least one number'
      WHEN NOT regexp_matches(text, '\p{L}') THEN 'Password must contain at least one letter'
      WHEN NOT regexp_matches(text, '\p{Lu}') THEN 'Password must contain at least one uppercase letter'
      WHEN NOT regexp_matches(text, '\p{Ll}') THEN 'Password must contain at least one lowercase letter' END AS error FROM documents""",
)
def f13(t):
    return validate.validate_first(t.documents, validate.password_rules("text")).select("doc_id", "error")


@query("f14_prefix", "SELECT p_partkey, CASE WHEN NOT starts_with(p_name, 'red') THEN 'name should start with red' END AS error FROM part")
def f14(t):
    rule = validate.prefix_rule("p_name", "red", "name should start with red")
    return validate.validate_first(t.part, [rule]).select("p_partkey", "error")


@query(
    "f15_phase_from_age",
    """SELECT event_id, CASE WHEN event_type = 'purchase' OR event_type = 'error' THEN CASE WHEN event_type = 'error' THEN 'failed' ELSE 'new' END
      WHEN age < 86400 THEN 'provisioning' WHEN age < 864000 THEN 'syncing' ELSE 'ready' END AS phase
    FROM (SELECT *, epoch(TIMESTAMP '2024-01-31 00:00:00' - ts) AS age FROM events)""",
)
def f15(t):
    e = t.events.select(
        "event_id",
        "ts",
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("run_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("new").alias("phase"),
    )
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return rows.phase_from_age(e, "ts", as_of, "phase", "run_id", (86400, 864000)).select("event_id", "phase")


@query("f16_usage_over", "SELECT s_suppkey, CAST(s_nationkey * 4 AS INTEGER) AS used_percent FROM supplier WHERE s_nationkey * 4 > 80")
def f16(t):
    report = F.concat(
        F.lit("Filesystem Size Used Avail Use% Mounted on\n/dev/sda1 99G 1G 1G "),
        (F.col("s_nationkey") * 4).cast("string"), F.lit("% /\n/dev/sdb1 9G 9G 0G 99% /data"),
    )
    return rows.usage_over(t.supplier.select("s_suppkey", report.alias("report")), "report", "/", 80)


@query(
    "f17_select_hosts",
    "SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice > 950 AND (p_type = 'ECONOMY' OR p_brand = 'Brand#3')",
)
def f17(t):
    keep = rows.select_hosts(
        t.part,
        [F.col("p_size") > 10, F.col("p_retailprice") > 950],
        [F.col("p_type") == "ECONOMY", F.col("p_brand") == "Brand#3"],
    )
    return keep.select("p_partkey")


RELABEL = [
    {"action": "keep", "source": ["__meta_type"], "regex": "click|view|purchase"},
    {"action": "drop", "source": ["__meta_k"], "regex": "1?\\d"},
    {"action": "replace", "source": ["__address__", "__meta_port"], "regex": r"(.+?)(?::\d+)?;(\d+)", "replacement": "$1:$2", "target": "__address__"},
    {"action": "labelmap", "regex": "__meta_label_(.+)"},
    {"action": "replace", "source": ["__meta_type"], "target": "type"},
]


@query(
    "f18_relabel",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN '10.0.0.' || user_id || ':9113' ELSE '10.0.0.' || user_id || ':8080' END AS address,
      event_type AS type, 'u' || user_id AS team, 'u' || user_id AS meta_team
    FROM events WHERE event_type IN ('click', 'view', 'purchase') AND NOT regexp_full_match(props->>'$.k', '1?\\d')""".replace("\\\\", "\\"),
)
def f18(t):
    labels = F.map_filter(
        F.create_map(
            F.lit("__address__"), F.concat(F.lit("10.0.0."), F.col("user_id"), F.lit(":8080")),
            F.lit("__meta_port"), F.when(F.col("event_type") == "click", F.lit("9113")),
            F.lit("__meta_type"), F.col("event_type"),
            F.lit("__meta_k"), F.get_json_object("props", "$.k"),
            F.lit("__meta_label_team"), F.concat(F.lit("u"), F.col("user_id")),
        ),
        lambda k, v: v.isNotNull(),
    )
    out = cluster.relabel(t.events.select("event_id", labels.alias("labels")), RELABEL)
    m = F.col("labels")
    return out.select(
        "event_id", m["__address__"].alias("address"), m["type"].alias("type"), m["team"].alias("team"),
        m["__meta_label_team"].alias("meta_team"),
    )


ROUTES = [
    {"pattern": {"source": ["shop"], "event_type": ["purchase", "signup"]}, "target": "billing"},
    {"pattern": {"event_type": ["error"]}, "target": "incidents"},
    {"pattern": {"source": ["shop"]}, "target": "audit"},
]


def sourced(t):
    return t.events.select("event_id", "event_type", F.when(F.col("user_id") < 75, "shop").otherwise("site").alias("source"))


@query(
    "f19_route",
    """SELECT event_id, CASE WHEN user_id < 75 AND event_type IN ('purchase', 'signup') THEN 'billing' WHEN event_type = 'error' THEN 'incidents'
      WHEN user_id < 75 THEN 'audit' END AS target FROM events""",
)
def f19(t):
    return rows.route(sourced(t), ROUTES).select("event_id", "target")


@query(
    "f19_route_all",
    """SELECT event_id, 'billing' AS target FROM events WHERE user_id < 75 AND event_type IN ('purchase', 'signup')
    UNION ALL SELECT event_id, 'incidents' FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'audit' FROM events WHERE user_id < 75""",
)
def f19b(t):
    return rows.route(sourced(t), ROUTES, first_only=False).select("event_id", "target")


@query(
    "f20_tier_by_age",
    """SELECT o_orderkey, d AS age_days, CASE WHEN d < 365 THEN 'hot' WHEN d < 1095 THEN 'cold' ELSE 'archive' END AS tier
    FROM (SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-09-01') AS INTEGER) AS d FROM orders)""",
)
def f20(t):
    as_of = F.lit("2001-09-01").cast("date")
    return rows.tier_by_age(t.orders, "o_orderdate", as_of, [(365, "hot"), (1095, "cold")], "archive").select("o_orderkey", "age_days", "tier")


@query(
    "f21_overdue",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) > 90""",
)
def f21(t):
    jobs = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate").join(
        t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    days = F.datediff("l_shipdate", "o_orderdate").cast("long")
    late = rows.overdue(jobs.withColumn("days", days), F.col("days") * 86400, F.lit(90 * 86400))
    return late.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "days")


@query(
    "f22_condition_status",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'P' THEN 'False' END AS ready,
      date_diff('day', o_orderdate, TIMESTAMP '2001-09-01') > 1000 AND o_orderstatus <> 'F' AS gave_up FROM orders""",
)
def f22(t):
    cond = lambda kind, status: F.struct(
        F.lit(kind).alias("type"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("lastTransitionTime")
    )
    ready = cond("Ready", F.when(F.col("o_orderstatus") == "F", "True").otherwise("False"))
    other = cond("Initialized", F.lit("True"))
    conditions = F.when(F.col("o_orderstatus") == "O", F.array(other)).otherwise(F.array(other, ready))
    objects = t.orders.select("o_orderkey", "o_orderdate", F.struct(conditions.alias("conditions")).alias("status"))
    as_of = F.lit("2001-09-01 00:00:00").cast("timestamp")
    out = cluster.condition_status(objects, "Ready", "o_orderdate", as_of, 1000 * 86400)
    return out.select("o_orderkey", F.col("condition").alias("ready"), "gave_up")


@query("f23_find_by_image", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR contains(p_name, 'gear')")
def f23(t):
    images = F.array(F.concat(F.lit("registry/"), F.lower("p_type")), F.concat(F.lit("promo-"), F.col("p_name")))
    objects = t.part.select("p_partkey", images.alias("images"))
    return cluster.find_by_image(objects, ["/promo", "gear"]).select("p_partkey")


@query(
    "f24_project_paths",
    """SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_nationkey) AS hosts, count(*) AS n FROM nation GROUP BY 1""",
)
def f24(t):
    rules = F.transform(
        F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.struct(r["n_name"].alias("host"))
    )
    objects = t.nation.groupBy("n_regionkey").agg(F.struct(rules.alias("rules")).alias("spec"))
    out = cluster.project_paths(objects, {"hosts": ("spec.rules", "host")})
    return out.select(F.col("n_regionkey").alias("region"), "hosts", F.size("spec.rules").cast("long").alias("n"))


@query("o1_order_by", "SELECT o_orderkey, o_orderdate FROM orders")
def o1(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy("o_orderkey")


@query("o2_offset_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey OFFSET 40 LIMIT 100")
def o2(t):
    return rows.page(t.customer.select("c_custkey", "c_name"), ["c_custkey"], 40, 100)


@query("o3_recent", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def o3(t):
    return rows.recent(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query("o4_limit_results", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10")
def o4(t):
    return rows.limit_results(t.part.select("p_partkey", "p_name"), ["p_partkey"])


@query("o5_recent_events", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def o5(t):
    return rows.recent_events(t.events.select("event_id", "ts"), ["ts", "event_id"])


@query("o6_sort_columns", "SELECT p_brand, p_type, p_name, p_partkey FROM part")
def o6(t):
    return t.part.select("p_brand", "p_type", "p_name", "p_partkey").orderBy("p_brand", "p_type", "p_name", "p_partkey")


@query(
    "a28_with_total",
    """SELECT o_orderkey, (SELECT count(*) FROM orders) AS total_count, CAST(100 AS BIGINT) AS page_count FROM orders ORDER BY o_orderkey LIMIT 100""",
)
def a28(t):
    keys = t.orders.select("o_orderkey")
    return rows.with_total(rows.page(keys, ["o_orderkey"], 0, 100), keys)
