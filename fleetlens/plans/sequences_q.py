"""Windows, rates, states and admission."""

from pyspark.sql import functions as F

from fleetlens.operators import capacity, intake, metrics, slo, tracking
from fleetlens.plans.registry import query
from fleetlens.session import written
from fleetlens.streaming.runs import new_folder

HOUR_US, DAY_US = 3600 * 10**6, 86400 * 10**6

RATE = """WITH s AS (SELECT event_type AS series, ts, epoch_us(ts) AS us, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS DOUBLE) AS v FROM events),
  p AS (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY us) AS pv, lag(us) OVER (PARTITION BY series ORDER BY us) AS pu FROM s),
  x AS (SELECT *, unnest(range(CAST(ceil(us / 3600e6) AS BIGINT), CAST(ceil(us / 3600e6) AS BIGINT) + 6)) AS t FROM p),
  g AS (SELECT series, t, count(*) AS n, min(us) AS t0, max(us) AS t1, arg_min(v, us) AS v0, arg_max(v, us) AS v1,
    sum(CASE WHEN pv > v AND pu > (t - 6) * 3600000000 THEN pv ELSE 0 END) AS resets FROM x GROUP BY 1, 2),
  h AS (SELECT *, v1 - v0 + resets AS inc, (t1 - t0) / 1e6 AS sampled, (t1 - t0) / 1e6 / (n - 1) AS gap, (t0 - (t - 6) * 3600000000) / 1e6 AS a, (t * 3600000000 - t1) / 1e6 AS b FROM g WHERE n >= 2),
  i AS (SELECT *, CASE WHEN a >= gap * 1.1 THEN gap / 2 ELSE a END AS a1, CASE WHEN b >= gap * 1.1 THEN gap / 2 ELSE b END AS b1 FROM h),
  j AS (SELECT *, CASE WHEN inc > 0 AND v0 >= 0 THEN least(a1, sampled * v0 / inc) ELSE a1 END AS a2 FROM i)
SELECT series, make_timestamp(t * 3600000000) AS tick, round(inc * (sampled + a2 + b1) / sampled / 21600, 9) AS rate FROM j"""


@query("w1_counter_rate", RATE)
def w1(t):
    return metrics.counter_rate(t.samples, ["series"], 6 * 3600, 3600).withColumn("rate", F.round("rate", 9))


THROTTLE = """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  r AS (SELECT event_id, user_id, ts, rn, true AS allowed, [ts] AS held FROM o WHERE rn = 1
    UNION ALL SELECT event_id, user_id, ts, rn, ok, CASE WHEN ok THEN list_append(live, ts) ELSE live END FROM
      (SELECT o.event_id, o.user_id, o.ts, o.rn, list_filter(r.held, lambda h: h > o.ts - INTERVAL 1 DAY) AS live,
        len(list_filter(r.held, lambda h: h > o.ts - INTERVAL 1 HOUR)) < 1 AND len(list_filter(r.held, lambda h: h > o.ts - INTERVAL 1 DAY)) < 2 AS ok
       FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
"""


def throttled(t):
    rows = t.events.select("event_id", "user_id", "ts")
    return intake.throttle(rows, ["user_id"], "ts", "event_id", 1, 2, HOUR_US, DAY_US, t.rows_per_task)


@query("w2_throttle", THROTTLE + "SELECT event_id, user_id, allowed FROM r")
def w2(t):
    return throttled(t).select("event_id", "user_id", "allowed")


@query(
    "w3_remaining",
    THROTTLE + "SELECT event_id, greatest(1 - len(list_filter(held, lambda h: h > ts - INTERVAL 1 HOUR)), 0)::BIGINT AS remaining FROM r",
)
def w3(t):
    return throttled(t).select("event_id", "remaining")


@query(
    "w4_dedup_ttl",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
      r AS (SELECT event_id, user_id, event_type, rn, true AS acquired, ts AS held FROM o WHERE rn = 1
        UNION ALL SELECT o.event_id, o.user_id, o.event_type, o.rn, o.ts >= r.held + INTERVAL 3 DAY, CASE WHEN o.ts >= r.held + INTERVAL 3 DAY THEN o.ts ELSE r.held END
        FROM r JOIN o ON o.user_id = r.user_id AND o.event_type = r.event_type AND o.rn = r.rn + 1)
    SELECT event_id, acquired FROM r""",
)
def w4(t):
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    return intake.dedup_ttl(rows, ["user_id", "event_type"], "ts", "event_id", 3 * DAY_US, t.rows_per_task).select("event_id", "acquired")


ALERTS = """WITH c AS (SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS tick, count(*) >= 3 AS active FROM events GROUP BY 1, 2),
  g AS (SELECT event_type, unnest(range(min(tick), max(tick) + 1, 3600)) AS tick FROM c GROUP BY 1),
  d AS (SELECT event_type, tick, coalesce(active, false) AS active FROM g LEFT JOIN c USING (event_type, tick)),
  q AS (SELECT *, max(CASE WHEN NOT active THEN tick END) OVER w AS quiet, min(tick) OVER w AS first FROM d WINDOW w AS (PARTITION BY event_type ORDER BY tick)),
  h AS (SELECT event_type, tick, active, tick - coalesce(quiet + 3600, first) AS held FROM q),
  s AS (SELECT event_type, tick, CASE WHEN NOT active THEN 'inactive' WHEN held >= 7200 THEN 'firing' ELSE 'pending' END AS state FROM h)
"""


def alert_ticks(t):
    tick = F.unix_timestamp(F.date_trunc("hour", "ts").cast("timestamp"))
    return t.events.groupBy("event_type", tick.alias("tick")).agg((F.count(F.lit(1)) >= 3).alias("active"))


@query("w5_alert_states", ALERTS + "SELECT * FROM s")
def w5(t):
    states = slo.alert_states(alert_ticks(t), ["event_type"], 3600, 7200, t.rows_per_task)
    return states.select("event_type", "tick", "state")


@query(
    "w5_alert_intervals",
    ALERTS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY tick) - row_number() OVER (PARTITION BY event_type, state ORDER BY tick) AS island FROM s)
    SELECT event_type, min(tick) AS from_tick, max(tick) AS to_tick, state FROM n GROUP BY event_type, state, island""",
)
def w5_intervals(t):
    found = slo.alert_intervals(alert_ticks(t), ["event_type"], 3600, 7200, t.rows_per_task)
    return found.select("event_type", "from_tick", "to_tick", "state")


@query(
    "a13_alert_count",
    ALERTS
    + """, f AS (SELECT *, lag(state) OVER (PARTITION BY event_type ORDER BY tick) AS before FROM s)
    SELECT event_type, sum((state = 'firing' AND before IS DISTINCT FROM 'firing')::INT)::BIGINT AS alerts FROM f GROUP BY 1""",
)
def a13(t):
    found = slo.alert_intervals(alert_ticks(t), ["event_type"], 3600, 7200, t.rows_per_task)
    return slo.alert_count(found, ["event_type"])


@query(
    "w6_islands",
    """WITH f AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type <> 'error' ORDER BY ts, event_id) AS g FROM events),
      i AS (SELECT user_id, ok, g, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM f GROUP BY 1, 2, 3)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY started) AS island, ok, started, ended, n FROM i""",
)
def w6(t):
    probes = t.requests.select("organization_id", "ts", "request_id", "ok")
    rows = slo.islands(probes, ["organization_id"], ["ts", "request_id"], "ok", t.rows_per_task)
    return rows.groupBy(F.col("organization_id").alias("user_id"), "island").agg(
        F.first("ok").alias("ok"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n")
    )


@query(
    "w7_probe_state",
    """WITH f AS (SELECT user_id, ts, event_id, event_type NOT IN ('error', 'signup') AS ok FROM events),
      g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, ok ORDER BY ts, event_id) AS g FROM f),
      h AS (SELECT *, row_number() OVER (PARTITION BY user_id, ok, g ORDER BY ts, event_id) AS run FROM g),
      i AS (SELECT *, CASE WHEN ok AND run = 2 THEN 'healthy' WHEN NOT ok AND run = 3 THEN 'unhealthy' END AS flip FROM h)
    SELECT event_id, run AS run_length, coalesce(last_value(flip IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'unknown') AS state FROM i""",
)
def w7(t):
    probes = t.events.select("user_id", "ts", "event_id", (~F.col("event_type").isin("error", "signup")).alias("ok"))
    return slo.probe_state(probes, ["user_id"], ["ts", "event_id"], 2, 3, rows_per_task=t.rows_per_task).select("event_id", "run_length", "state")


SPEC = {**capacity.DEFAULT_SPEC, "stabilise_seconds": 21600}


@query(
    "w8_replica_recommendation",
    """WITH m AS (SELECT event_id, event_type, epoch(date_trunc('second', ts))::BIGINT AS s, 2 + CAST(props->>'$.k' AS INT) % 9 AS cur, value AS cpu, CAST(props->>'$.k' AS INT) AS mem FROM events),
      d AS (SELECT *, least(greatest(greatest(CASE WHEN abs(cpu / 70.0::DOUBLE - 1) <= 0.1::DOUBLE THEN cur ELSE ceil(cur * (cpu / 70.0::DOUBLE)) END, CASE WHEN abs(mem / 80.0::DOUBLE - 1) <= 0.1::DOUBLE THEN cur ELSE ceil(cur * (mem / 80.0::DOUBLE)) END), 2), 10)::BIGINT AS desired FROM m),
      w AS (SELECT *, max(desired) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS st FROM d),
      c AS (SELECT *, CASE WHEN desired < cur THEN least(st, cur) ELSE desired END AS calm FROM w)
    SELECT event_id, desired, least(greatest(least(greatest(calm, floor(cur * 0.5::DOUBLE)), greatest(ceil(cur * 2.0::DOUBLE), cur + 2)), 2), 10)::BIGINT AS recommended FROM c""",
)
def w8(t):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.select("event_id", "event_type", "ts", (k % 9 + 2).alias("current_replicas"), F.col("value").alias("cpu"), k.alias("memory"))
    return capacity.replica_recommendation(rows, ["event_type"], "ts", SPEC).select("event_id", "desired", "recommended")


@query(
    "w9_queue_replicas",
    """WITH q AS (SELECT o_custkey, count(*) AS lag, max(o_totalprice) / 5000 AS cpu FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT o_custkey, lag, least(greatest(greatest(ceil(lag / 2.0::DOUBLE), ceil(3 * cpu / 70.0::DOUBLE)), 2), 100)::BIGINT AS replicas FROM q""",
)
def w9(t):
    lag = t.orders.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("lag"), (F.max("o_totalprice") / 5000).alias("cpu"), F.lit(3).alias("current_replicas")
    )
    return capacity.queue_replicas(lag, 2, 2, 100, 70.0).select("o_custkey", "lag", "replicas")


@query("w10_last_n", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def w10(t):
    return tracking.last_n(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 50)


@query(
    "w11_latest",
    "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def w11(t):
    return tracking.latest(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query("w12_assign_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def w12(t):
    rows = t.orders.select("o_orderdate", "o_orderkey")
    return capacity.assign_ids(rows, ["o_orderdate", "o_orderkey"], rows_per_task=t.rows_per_task).select("o_orderkey", "id")


@query(
    "w13_positions",
    """SELECT o_custkey, o_orderkey, row_number() OVER w AS position, row_number() OVER w = 1 AS is_first, lead(o_orderkey) OVER w IS NULL AS is_last FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
)
def w13(t):
    return capacity.positions(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], t.rows_per_task)


@query("w14_tail", "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w14(t):
    return tracking.tail(t.conversations.select("conv_id", "turn", "text"), ["conv_id"], ["turn"], 3)


@query(
    "w15_concurrency",
    """WITH j AS (SELECT o_orderpriority AS p, o_orderdate AS s, l_shipdate AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      c AS (SELECT p, instant, sum(d) AS d FROM (SELECT p, s AS instant, 1 AS d FROM j UNION ALL SELECT p, e, -1 FROM j) GROUP BY 1, 2)
    SELECT p AS o_orderpriority, instant, (sum(d) OVER w)::BIGINT AS running, sum(d) OVER w > 100 AS over_limit FROM c WINDOW w AS (PARTITION BY p ORDER BY instant)""",
)
def w15(t):
    jobs = t.lineitem.select("l_orderkey", "l_shipdate").join(
        t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return capacity.concurrency(jobs, ["o_orderpriority"], "o_orderdate", "l_shipdate", 100)


@query(
    "w16_throttle_state",
    """WITH a AS (SELECT user_id, ts, CAST(1 + CAST(props->>'$.k' AS INT) % 3 AS BIGINT) AS cost, ts > TIMESTAMP '2024-01-20' - INTERVAL 1 DAY AS near FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20')
    SELECT user_id, coalesce(sum(CASE WHEN near THEN cost END), 0)::BIGINT AS used_short, sum(cost)::BIGINT AS used_long, min(CASE WHEN near THEN ts END) + INTERVAL 1 DAY AS reset_short, min(ts) + INTERVAL 7 DAY AS reset_long,
      5::BIGINT AS limit_short, 30::BIGINT AS limit_long, coalesce(sum(CASE WHEN near THEN cost END), 0) >= 5 OR sum(cost) >= 30 AS is_throttled FROM a GROUP BY 1""",
)
def w16(t):
    cost = (F.get_json_object("props", "$.k").cast("int") % 3 + 1).cast("long")
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    rows = t.events.select("user_id", "ts", cost.alias("cost"))
    return capacity.throttle_state(rows, ["user_id"], as_of, 86400, 7 * 86400, 5, 30)


@query(
    "w17_token_bucket",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) // 86400000000 AS tick, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      r AS (SELECT event_id, user_id, rn, tick, true AS allowed, 4::BIGINT AS tokens FROM o WHERE rn = 1
        UNION ALL SELECT event_id, user_id, rn, tick, have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END FROM
          (SELECT o.event_id, o.user_id, o.rn, o.tick, least(5, r.tokens + 2 * (o.tick - r.tick)) AS have FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
    SELECT event_id, allowed, tokens FROM r""",
)
def w17(t):
    rows = t.events.select("event_id", "user_id", "ts")
    return intake.token_bucket(rows, ["user_id"], "ts", "event_id", 5, 2, DAY_US, t.rows_per_task).select("event_id", "allowed", "tokens")


def job_requests(t):
    """Events as job requests: some lack a type, some have no timeout, prompts repeat."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("org"), F.col("user_id")).alias("organization_id"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).otherwise("").alias("job_type"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("prompt "), k % 2)).alias("prompt"),
        F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")).alias("parameters"),
        F.when(F.col("event_type") == "view", F.lit("")).otherwise("payload").alias("payload"),
        F.when(k < 90, 30).alias("timeout_seconds"),
        F.lit("").alias("callback_url"),
    )


def intake_sql(final: str, known: str = "", window: str = "TRUE", refused: str = "FALSE", unthrottled: bool = False, told: str = "", more: str = "") -> str:
    """Requests one after the other per tenant: quota held, locks held. ``known`` are further tables, ``window`` picks
    requests, ``refused`` those that the queue does not take, which give back their locks at once or, with ``told``, where that
    holds for lock l and request o (with columns ``more``); ``final`` reads v (requests) and r (decisions)."""
    keeps = "TRUE" if told else "NOT refused"
    ok = "TRUE" if unthrottled else (
        "len(list_filter(r.held, lambda h: h > o.ts - INTERVAL 1 HOUR)) < 2 AND len(list_filter(r.held, lambda h: h > o.ts - INTERVAL 1 DAY)) < 2"
    )
    return f"""WITH RECURSIVE {known} q AS (SELECT event_id, ts, 'org' || user_id AS org, CASE WHEN event_type = 'signup' THEN '' ELSE event_type END AS job_type, CAST(props->>'$.k' AS INT) AS k, event_type, {refused} AS refused{more} FROM events WHERE {window}),
      v AS (SELECT *, CASE WHEN job_type = '' THEN 'job_type is required' WHEN event_type = 'view' THEN 'either prompt or payload is required' WHEN k >= 90 THEN 'timeout_seconds must be positive' END AS error,
        'mcp:job:' || org || ':' || job_type || ':' || sha256(CASE WHEN event_type = 'view' THEN 'view' ELSE 'prompt ' || (k % 2) || job_type || 'payload' END || 'a1b2') AS key,
        '{{"job_id":"' || sha256(event_id::VARCHAR) || '","organization_id":"' || org || '","job_type":"' || job_type || '","prompt":"prompt ' || (k % 2) || '","parameters":{{"b":"2","a":"1"}},"payload":"payload","timeout_seconds":30,"callback_url":"","created_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}}' AS envelope FROM q),
      o AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY ts, event_id::VARCHAR) AS rn FROM v WHERE error IS NULL),
      r AS (SELECT event_id, org, ts, rn, CASE WHEN refused THEN 'refused' ELSE 'accepted' END AS outcome, [ts] AS held, CASE WHEN {keeps} THEN [{{'k': key, 't': ts, 'r': refused}}] ELSE [] END AS locks FROM o WHERE rn = 1
        UNION ALL SELECT event_id, org, ts, rn, CASE WHEN NOT ok THEN 'throttled' WHEN taken THEN 'duplicate' WHEN refused THEN 'refused' ELSE 'accepted' END,
          CASE WHEN ok THEN list_append(live, ts) ELSE live END, CASE WHEN ok AND NOT taken AND {keeps} THEN list_append(valid, {{'k': key, 't': ts, 'r': refused}}) ELSE valid END
        FROM (SELECT *, len(list_filter(valid, lambda l: l.k = key)) > 0 AS taken FROM
          (SELECT o.event_id, o.org, o.ts, o.rn, o.key, o.refused, list_filter(r.held, lambda h: h > o.ts - INTERVAL 1 DAY) AS live, list_filter(r.locks, lambda l: l.t + INTERVAL 3 DAY > o.ts AND NOT ({told or 'FALSE'})) AS valid,
            {ok} AS ok
           FROM r JOIN o ON o.org = r.org AND o.rn = r.rn + 1)))
    {final}"""


OUTCOMES = """SELECT v.event_id::VARCHAR AS request_id, v.org AS organization_id, v.error, coalesce(r.outcome, 'invalid') AS outcome, v.key AS lock_key,
      CASE WHEN r.outcome = 'accepted' THEN v.envelope END AS envelope FROM v LEFT JOIN r USING (event_id)"""


@query("t1_intake", intake_sql(OUTCOMES))
def t1(t):
    rules = intake.SlidingThrottle(2, 2, HOUR_US, DAY_US)
    out = intake.intake(job_requests(t), rules, intake.TtlLocks(3 * DAY_US), t.rows_per_task)
    return out.select("request_id", "organization_id", "error", "outcome", "lock_key", "envelope")


@query("t1_unthrottled", intake_sql(OUTCOMES, unthrottled=True))
def t1_unthrottled(t):
    out = intake.intake(job_requests(t), intake.NoThrottle(), intake.TtlLocks(3 * DAY_US), t.rows_per_task)
    return out.select("request_id", "organization_id", "error", "outcome", "lock_key", "envelope")


@query(
    "x4_queue_refusals",
    intake_sql(
        """SELECT v.event_id::VARCHAR AS request_id, coalesce(r.outcome, 'invalid') AS outcome, CASE WHEN r.outcome = 'accepted' THEN v.org END AS key,
        CASE WHEN r.outcome = 'accepted' THEN v.envelope END AS value FROM v LEFT JOIN r USING (event_id)""",
        refused="event_id % 5 = 0",
    ),
)
def x4(t):
    """The queue refuses every fifth request; those release their locks, the others are read back from it."""
    requests = job_requests(t)
    refused = requests.filter(F.col("request_id").cast("long") % 5 == 0).select("request_id")
    rules, path = intake.SlidingThrottle(2, 2, HOUR_US, DAY_US), new_folder(t.spark, "refusing-queue")
    labelled = intake.intake(requests, rules, intake.TtlLocks(3 * DAY_US), t.rows_per_task, refused)
    labelled = written(labelled.select("request_id", "organization_id", "outcome", "envelope"), "labelled")
    intake.enqueue(labelled, lambda messages: messages.write.parquet(path))
    job = F.sha2("request_id", 256)
    sent = t.spark.read.schema("key string, value string").parquet(path)
    sent = sent.withColumn("job", F.get_json_object("value", "$.job_id"))
    return labelled.select("request_id", "outcome", job.alias("job")).join(sent, "job", "left").drop("job")
