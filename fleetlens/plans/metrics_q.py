"""Aggregates and service objectives."""

from pyspark.sql import functions as F

from fleetlens.operators import capacity, cluster, metrics, quotas, slo
from fleetlens.plans.registry import query

# the requests view in SQL
REQ = """(SELECT event_id AS request_id, user_id AS organization_id, ts, event_type, event_type <> 'error' AS ok, value AS latency_ms,
  CAST(props->>'$.k' AS INTEGER) AS k, (CAST(props->>'$.k' AS INTEGER) % 5 + 1) * 100 + CAST(props->>'$.k' AS INTEGER) AS code FROM events)"""
SPANS = """(SELECT o_orderkey AS trace_id, NULL AS parent_id, o_orderdate AS s, o_orderdate AS e FROM orders
  UNION ALL SELECT l_orderkey, 'o', o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DAY = "date_trunc('day', ts)"


def r(name, digits=6):
    return F.round(name, digits).alias(name)


@query("a1_counters", "SELECT event_type, count(*) AS total FROM events GROUP BY 1")
def a1(t):
    return metrics.counters(t.events, "event_type")


@query("a1_running_counters", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS total FROM events")
def a1b(t):
    rows = t.events.select("event_id", "event_type", "ts")
    return metrics.running_counters(rows, "event_type", ["ts", "event_id"], t.rows_per_task).drop("ts")


@query(
    "a2_consumer_lag",
    """WITH e AS (SELECT o_orderpriority AS g, o_orderkey % 8 AS p, max(o_orderkey) AS x, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS y FROM orders GROUP BY 1, 2)
    SELECT g AS "group", sum(greatest(x - coalesce(y, 0), 0))::BIGINT AS lag, sum(greatest(x - coalesce(y, 0), 0)) > 100 AS over FROM e GROUP BY 1""",
)
def a2(t):
    offsets = t.orders.select(
        F.col("o_orderpriority").alias("group"), (F.col("o_orderkey") % 8).alias("partition"), F.col("o_orderkey").alias("offset"), "o_orderstatus"
    )
    return capacity.consumer_lag(offsets, offsets.filter("o_orderstatus = 'F'"), 100)


@query("a3_availability", "SELECT organization_id, count(*) AS total, sum(ok::INT)::BIGINT AS successful, round(avg(ok::INT), 6) AS availability FROM " + REQ + " GROUP BY 1")
def a3(t):
    return metrics.availability(t.requests, ["organization_id"]).withColumn("availability", F.round("availability", 6))


@query(
    "a4_latency",
    f"""SELECT event_type, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms FROM {REQ} GROUP BY 1""",
)
def a4(t):
    return metrics.latency(t.requests, ["event_type"], t.rows_per_task).select("event_type", r("mean_ms"), r("p95_ms"), r("p99_ms"))


@query(
    "a5_error_rate",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS total, sum((NOT ok)::INT)::BIGINT AS errors, round(avg((NOT ok)::INT), 6) AS error_rate FROM {REQ} GROUP BY 1""",
)
def a5(t):
    return metrics.error_rate(t.requests, [], 3600).withColumn("error_rate", F.round("error_rate", 6))


@query(
    "a6_throughput",
    "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, round(count(*) / 3600.0::DOUBLE, 9) AS per_second FROM events GROUP BY 1, 2",
)
def a6(t):
    return metrics.throughput(t.requests, ["event_type"], 3600).withColumn("per_second", F.round("per_second", 9))


@query(
    "a7_saturation",
    """SELECT p_partkey, round(coalesce(load, 0), 4) AS load, round(CASE WHEN cap <> 0 THEN coalesce(load, 0) / cap END, 6) AS saturation
    FROM (SELECT p_partkey, (p_size - 10) * 10 AS cap FROM part) LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS load FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
)
def a7(t):
    cap = t.part.select("p_partkey", ((F.col("p_size") - 10) * 10).alias("cap"))
    usage = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return metrics.saturation(usage, cap, "p_partkey", "l_quantity", "cap").select("p_partkey", r("load", 4), r("saturation"))


@query(
    "a8_status_classes",
    f"""SELECT event_type, sum((code // 100 = 2)::INT)::BIGINT AS class_2xx, sum((code // 100 = 3)::INT)::BIGINT AS class_3xx, sum((code // 100 = 4)::INT)::BIGINT AS class_4xx,
      sum((code // 100 = 5)::INT)::BIGINT AS class_5xx FROM {REQ} GROUP BY 1""",
)
def a8(t):
    return metrics.status_classes(t.requests, ["event_type"])


def started(t):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("started_at"), F.max("l_shipdate").alias("completed_at"))
    return t.orders.join(first, F.col("l_orderkey") == F.col("o_orderkey"))


@query(
    "a9_queue_time",
    """SELECT o_orderpriority, round(avg(epoch(s - o_orderdate)), 4) AS mean_wait_seconds FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""",
)
def a9(t):
    jobs = started(t).withColumnRenamed("o_orderdate", "created_at")
    return metrics.queue_time(jobs, ["o_orderpriority"]).withColumn("mean_wait_seconds", F.round("mean_wait_seconds", 4))


INCIDENTS = f"""(SELECT * FROM (SELECT organization_id, ok, ts AS started, lead(ts) OVER (PARTITION BY organization_id ORDER BY ts, request_id) AS recovered
  FROM (SELECT *, lag(ok) OVER (PARTITION BY organization_id ORDER BY ts, request_id) AS prev FROM {REQ}) WHERE prev IS DISTINCT FROM ok) WHERE NOT ok)"""


def found(t):
    probes = t.requests.select("organization_id", "ts", "request_id", "ok")
    return slo.incidents(probes, ["organization_id"], ["ts", "request_id"], rows_per_task=t.rows_per_task)


@query("a10_incidents", f"SELECT date_trunc('day', started) AS period, count(*) AS incidents FROM {INCIDENTS} GROUP BY 1")
def a10(t):
    return slo.incident_count(found(t), F.date_trunc("day", "started").cast("timestamp_ntz"))


@query("a11_mttr", f"SELECT organization_id, count(*) AS closed, round(avg(epoch(recovered - started)), 4) AS mttr_seconds FROM {INCIDENTS} WHERE recovered IS NOT NULL GROUP BY 1")
def a11(t):
    return slo.mttr(found(t), ["organization_id"]).withColumn("mttr_seconds", F.round("mttr_seconds", 4))


@query(
    "a12_mtbf",
    f"SELECT organization_id, count(*) AS incidents, round(avg(epoch(started - before)), 3) AS mtbf_seconds FROM (SELECT *, lag(started) OVER (PARTITION BY organization_id ORDER BY started) AS before FROM {INCIDENTS}) GROUP BY 1",
)
def a12(t):
    return slo.mtbf(found(t), ["organization_id"]).withColumn("mtbf_seconds", F.round("mtbf_seconds", 3))


@query("a14_active_users", "SELECT date_trunc('day', ts) AS period, count(DISTINCT user_id) AS active_users FROM events GROUP BY 1")
def a14(t):
    return metrics.active_users(t.events, "user_id", F.expr(DAY).cast("timestamp_ntz"))


@query(
    "a15_sessions",
    """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM f)
    SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events, round(epoch(max(ts) - min(ts)), 6) AS seconds FROM s GROUP BY 1, 2""",
)
def a15(t):
    return metrics.sessions(t.events, ["user_id"], "ts", "event_id", 1800, t.rows_per_task).withColumn("seconds", F.round("seconds", 6))


@query(
    "a16_churn",
    """WITH a AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS p FROM events),
      j AS (SELECT a.*, b.user_id IS NULL AS gone FROM a LEFT JOIN a b ON a.user_id = b.user_id AND b.p = a.p + 1 WHERE a.p < (SELECT max(p) FROM a))
    SELECT p AS period, count(*) AS active, sum(gone::INT)::BIGINT AS churned, round(avg(gone::INT), 6) AS churn_rate FROM j GROUP BY 1""",
)
def a16(t):
    day = F.unix_date(F.to_date("ts")).cast("long")
    return metrics.churn(t.events, "user_id", day).withColumn("churn_rate", F.round("churn_rate", 6))


@query("a17_slow_share", "SELECT event_type, round(avg((value > 100)::INT), 6) AS slow_share FROM events GROUP BY 1")
def a17(t):
    return metrics.slow_share(t.requests, ["event_type"], 100).withColumn("slow_share", F.round("slow_share", 6))


@query("a18_failed_calls", "SELECT user_id AS organization_id, count(*) AS failed FROM events WHERE event_type = 'error' GROUP BY 1")
def a18(t):
    return metrics.failed_calls(t.requests, ["organization_id"])


@query(
    "a19_infra_rollup",
    f"""SELECT organization_id, round(count(*) / epoch(max(ts) - min(ts)), 9) AS iops, round(avg(latency_ms), 6) AS mean_ms, round(avg(ok::INT), 6) AS healthy_ratio, bool_and(ok) AS healthy FROM {REQ} GROUP BY 1""",
)
def a19(t):
    return metrics.infra_rollup(t.requests, ["organization_id"]).select(
        "organization_id", r("iops", 9), r("mean_ms"), r("healthy_ratio"), "healthy"
    )


@query(
    "a20_error_budget",
    f"""SELECT organization_id, time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS total, sum((NOT ok)::INT)::BIGINT AS bad, round(sum((NOT ok)::INT) / (count(*) * 0.2::DOUBLE), 6) AS budget_used,
      round(1 - sum((NOT ok)::INT) / (count(*) * 0.2::DOUBLE), 6) AS budget_left, sum((NOT ok)::INT) / (count(*) * (1 - 0.8::DOUBLE)) > 1 AS violated FROM {REQ} GROUP BY 1, 2""",
)
def a20(t):
    out = slo.error_budget(t.requests, 0.8, 30, ["organization_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("budget_used", "budget_left")})


@query(
    "a21_sla",
    f"""SELECT organization_id, time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS total, sum((NOT ok)::INT)::BIGINT AS bad, sum((NOT ok)::INT) / (count(*) * (1 - (0.8::DOUBLE - 0.02::DOUBLE))) > 1 AS breached FROM {REQ} GROUP BY 1, 2""",
)
def a21(t):
    return slo.sla(t.requests, 0.8, 0.02, 30, ["organization_id"])


@query(
    "a22_job_stats",
    """WITH j AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'FAILED' ELSE 'COMPLETED' END AS status, epoch(c - o_orderdate) AS d FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
    SELECT o_custkey, count(*) AS jobs, round(sum((status = 'COMPLETED')::INT) / nullif(sum((status <> 'PENDING')::INT), 0), 6) AS success_rate,
      round(sum((status = 'FAILED')::INT) / nullif(sum((status <> 'PENDING')::INT), 0), 6) AS failure_rate, round(avg(d), 4) AS mean_seconds, sum((status = 'PENDING')::INT)::BIGINT AS pending FROM j GROUP BY 1""",
)
def a22(t):
    status = F.expr("CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'FAILED' ELSE 'COMPLETED' END")
    seconds = (F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).cast("double")
    jobs = started(t).select("o_custkey", status.alias("status"), seconds.alias("duration_seconds"))
    return metrics.job_stats(jobs, ["o_custkey"]).select("o_custkey", "jobs", r("success_rate"), r("failure_rate"), r("mean_seconds", 4), "pending")


@query(
    "a23_worker_stats",
    f"""SELECT organization_id, round(count(*) / 2592000.0::DOUBLE, 9) AS per_second, round(avg((NOT ok)::INT), 6) AS error_rate, count(DISTINCT event_type) AS tools,
      round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms FROM {REQ} GROUP BY 1""",
)
def a23(t):
    out = metrics.worker_stats(t.requests.withColumnRenamed("event_type", "tool"), ["organization_id"], 30 * 86400, t.rows_per_task)
    return out.select("organization_id", r("per_second", 9), r("error_rate"), "tools", r("mean_ms"), r("p95_ms"), r("p99_ms"))


@query(
    "a24_quota_usage",
    """WITH u AS (SELECT l_suppkey AS namespace, 'cpu' AS resource, sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS INT) * 100 END) / 1000.0::DOUBLE AS used, count(*) FILTER (l_returnflag = 'R') AS unread FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'memory', sum(l_linenumber) * 1048576.0::DOUBLE, 0 FROM lineitem GROUP BY 1),
      q AS (SELECT s_suppkey AS namespace, 'cpu' AS resource, (1000 + s_nationkey * 30)::DOUBLE AS hard FROM supplier UNION ALL SELECT s_suppkey, 'memory', (2 + s_nationkey % 2) * 1073741824.0::DOUBLE FROM supplier)
    SELECT namespace, resource, round(coalesce(used, 0), 4) AS used, coalesce(unread, 0) AS unread, hard, coalesce(used, 0) > hard AS exceeded FROM q LEFT JOIN u USING (namespace, resource)""",
)
def a24(t):
    use = lambda name, amount: F.struct(F.lit(name).alias("resource"), amount.alias("amount"))
    # some amounts are no quantities, others have an exponent
    cpu = F.when(F.col("l_returnflag") == "R", "a lot").otherwise(F.concat((F.col("l_quantity").cast("int") * 100).cast("string"), F.lit("m")))
    cpu = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), F.concat((F.col("l_quantity").cast("int")).cast("string"), F.lit("e-1"))).otherwise(cpu)
    mem = F.concat(F.col("l_linenumber").cast("string"), F.lit("Mi"))
    usage = t.lineitem.select(F.col("l_suppkey").alias("namespace"), F.explode(F.array(use("cpu", cpu), use("memory", mem))).alias("u")).select("namespace", "u.*")
    hard = lambda name, amount: F.struct(F.lit(name).alias("resource"), amount.alias("hard"))
    limits = F.array(
        hard("cpu", (F.col("s_nationkey") * 30 + 1000).cast("string")), hard("memory", F.concat((F.col("s_nationkey") % 2 + 2).cast("string"), F.lit("Gi")))
    )
    quota = t.supplier.select(F.col("s_suppkey").alias("namespace"), F.explode(limits).alias("q")).select("namespace", "q.*")
    return quotas.quota_usage(usage, quota).withColumn("used", F.round("used", 4))


@query("a25_top", "SELECT l_suppkey, round(sum(l_quantity), 2) AS l_quantity, sum(l_linenumber)::BIGINT AS l_linenumber FROM lineitem GROUP BY 1")
def a25(t):
    return metrics.top(t.lineitem, "l_suppkey", ["l_quantity", "l_linenumber"]).withColumn("l_quantity", F.round("l_quantity", 2))


def workloads(t, lo, hi):
    c = lambda name, image: F.struct(F.lit(name).alias("name"), image.alias("image"))
    containers = F.array(c("app", F.concat(F.lit("registry/"), "p_type")), c("proxy", F.concat(F.lit("proxy:"), F.col("p_size"))))
    return t.part.filter(F.col("p_size").between(lo, hi)).select(
        F.struct(F.col("p_brand").alias("namespace"), F.concat(F.lit("w"), F.col("p_partkey")).alias("name")).alias("metadata"),
        F.struct(F.struct(F.struct(containers.alias("containers")).alias("spec")).alias("template")).alias("spec"),
    )


INVENTORY = """(SELECT p_brand AS namespace, CASE WHEN p_size <= 15 THEN 'deployment' WHEN p_size <= 30 THEN 'daemonset' ELSE 'statefulset' END AS kind, 'w' || p_partkey AS name, unnest(['app', 'proxy']) AS container,
  unnest(['registry/' || p_type, 'proxy:' || p_size]) AS image FROM part)"""


def inventory(t):
    return cluster.image_inventory(("deployment", workloads(t, 0, 15)), ("daemonset", workloads(t, 16, 30)), ("statefulset", workloads(t, 31, 1000)))


@query("u1_u4_image_rows", f"SELECT * FROM {INVENTORY}")
def a26(t):
    return inventory(t)


@query("a26_image_totals", f"SELECT count(*) AS images, count(DISTINCT image) AS distinct_images FROM {INVENTORY}")
def a26b(t):
    return inventory(t).agg(F.count(F.lit(1)).alias("images"), F.count_distinct("image").alias("distinct_images"))


@query(
    "a27_node_resources",
    """SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN s_nationkey ELSE 0 END AS gpus, CASE WHEN s_nationkey < 10 THEN 'A,N' || s_nationkey ELSE '' END AS device_ids FROM supplier""",
)
def a27(t):
    base = (F.lit("CPU"), F.lit(8.0))
    nation = F.col("s_nationkey").cast("string")
    gpu = F.create_map(
        *base, F.lit("GPU"), F.col("s_nationkey") + 0.5, F.concat(F.lit("accelerator_type:N"), nation), F.lit(1.0), F.lit("accelerator_type:A"), F.lit(1.0)
    )
    nodes = t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") < 10, gpu).otherwise(F.create_map(*base)).alias("resources"))
    return cluster.node_resources(nodes).select("s_suppkey", "gpus", F.array_join("device_ids", ",").alias("device_ids"))


@query("a29_run_failed", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1")
def a29(t):
    steps = t.lineitem.select("l_orderkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("exit_code"))
    return metrics.run_failed(steps, ["l_orderkey"])


@query("a30_rollup_health", "SELECT user_id, CASE WHEN bool_and(value < 150 OR event_type = 'signup') THEN 'healthy' ELSE 'degraded' END AS status FROM events GROUP BY 1")
def a30(t):
    checks = t.events.select("user_id", (F.col("value") < 150).alias("ok"), (F.col("event_type") != "signup").alias("required"))
    return metrics.rollup_health(checks, ["user_id"])


@query(
    "a31_dr_compliance",
    f"""WITH d AS (SELECT organization_id, max(epoch(recovered - started)) AS w FROM {INCIDENTS} WHERE recovered IS NOT NULL GROUP BY 1),
      l AS (SELECT user_id AS organization_id, epoch(max(ts) - max(CASE WHEN event_type = 'purchase' THEN ts END)) AS loss FROM events GROUP BY 1)
    SELECT organization_id, round(loss, 6) AS data_loss, round(coalesce(w, 0), 6) AS worst_downtime, coalesce(w, 0) <= 172800 AS rto_met, coalesce(loss <= 86400, false) AS rpo_met FROM l LEFT JOIN d USING (organization_id)""",
)
def a31(t):
    primary = t.requests.select("organization_id", "ts")
    replicas = t.requests.filter("event_type = 'purchase'").select("organization_id", "ts")
    out = slo.dr_compliance(found(t), primary, replicas, ["organization_id"], 172800, 86400)
    return out.withColumns({c: F.round(c, 6) for c in ("data_loss", "worst_downtime")})


@query(
    "a32_trace_stats",
    f"SELECT trace_id, count(*) AS spans, sum((parent_id IS NOT NULL)::INT)::BIGINT AS children, epoch(max(e) - min(s)) AS seconds FROM {SPANS} GROUP BY 1",
)
def a32(t):
    return metrics.trace_stats(t.spans)


@query(
    "a33_load_profile",
    "SELECT count(*) AS requests, count(DISTINCT user_id) AS users, round(count(*) / count(DISTINCT user_id), 6) AS per_user, round(count(*) / 2592000.0::DOUBLE, 9) AS per_second FROM events",
)
def a33(t):
    return metrics.load_profile(t.requests, 30 * 86400).withColumns({"per_user": F.round("per_user", 6), "per_second": F.round("per_second", 9)})


@query("a34_posts_by_user", "SELECT o_custkey, count(*) AS posts FROM orders GROUP BY 1")
def a34(t):
    return metrics.posts_by_user(t.orders, "o_custkey")
