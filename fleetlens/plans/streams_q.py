"""Streams run to their end over the given tables, and batched prediction."""

from contextlib import nullcontext, suppress

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fleetlens.operators import inference, intake
from fleetlens.plans.registry import ORACLES, query
from fleetlens.plans.rows_q import ROUTES
from fleetlens.plans.sequences_q import DAY_US, HOUR_US, OUTCOMES, intake_sql, job_requests
from fleetlens.sources import files, queue
from fleetlens.streaming import intake as intake_s
from fleetlens.streaming import metrics as metrics_s
from fleetlens.streaming import tracking as tracking_s
from fleetlens.streaming.runs import (
    Drain, folder_stream, new_folder, plain_checkpoints, run_to_end, state_at_end, table_stream,
)


def drained(t, table, rows):
    """The rows that ``rows`` makes of a table, as a stream with a drain."""
    drain = Drain(rows(with_instants(getattr(t, table))))
    return drain.stream(rows(table_stream(t.spark, t.sf_dir, table))), drain


def with_instants(df):
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


@query("s2_queue_stream", "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s2(t):
    path = new_folder(t.spark, "queue")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    queue.write_jobs(queue.to_messages(rows, "o_custkey"), path)
    stream = queue.from_messages(queue.read_jobs_stream(t.spark, path), rows.schema)
    return run_to_end(stream.drop("o_custkey"), "s2")


@query(
    "s2_bounded_fetch",
    "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey, o_orderstatus, TRUE AS within FROM orders",
)
def s2_bounded(t):
    """Fetches of at most 4,000 messages by two consumers for each core, as one waits for its logs while the other works;
    the first one of each fails after its work is done, and its query is started again."""
    path, sink, limit = new_folder(t.spark, "queue"), new_folder(t.spark, "fetched"), 4000
    consumers = 2 * t.spark.sparkContext.defaultParallelism
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    queue.write_jobs(queue.to_messages(rows, "o_custkey"), path, per_file=1000, partitions=consumers)

    def started(consumer: int, fails: bool):
        def each(batch, epoch):
            # a fetch is few rows, so one task's work; nobody reads a mark of success
            writer = batch.coalesce(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
            writer.parquet(f"{sink}/consumer={consumer}/epoch={epoch}")
            if fails:
                raise RuntimeError("the worker is lost")

        asked = queue.read_jobs_stream(t.spark, queue.partition_path(path, consumer), fetch_limit=limit, per_file=1000)
        stream = queue.from_messages(asked, rows.schema).writeStream.foreachBatch(each)
        return stream.option("checkpointLocation", f"{sink}-checkpoint/{consumer}").trigger(availableNow=True).start()

    with plain_checkpoints(t.spark, sink):
        for fails in (True, False):
            for query_ in [started(consumer, fails) for consumer in range(consumers)]:
                with suppress(StreamingQueryException) if fails else nullcontext():
                    query_.awaitTermination()
    # the folder must be there, also when nothing was fetched
    empty = rows.limit(0).select(F.lit("").alias("key"), "*")
    empty.write.parquet(f"{sink}/consumer=0/epoch=-1")
    got = t.spark.read.parquet(sink)
    sizes = got.groupBy("consumer", "epoch").agg((F.count(F.lit(1)) <= limit).alias("within"))
    return got.join(sizes, ["consumer", "epoch"]).select("key", "o_orderkey", "o_orderstatus", "within")


@query(
    "s11_fan_out",
    "SELECT 'archive' AS sink, event_id, event_type FROM events UNION ALL SELECT 'errors', event_id, event_type FROM events WHERE event_type = 'error'",
)
def s11(t):
    a, b = new_folder(t.spark, "archive"), new_folder(t.spark, "errors")
    stream = table_stream(t.spark, t.sf_dir, "events").select("event_id", "event_type")
    sinks = [
        lambda df, epoch: df.write.mode("overwrite").parquet(f"{a}/epoch={epoch}"),
        lambda df, epoch: df.filter("event_type = 'error'").write.mode("overwrite").parquet(f"{b}/epoch={epoch}"),
    ]
    files.fan_out(stream, sinks, a + "-checkpoint").awaitTermination()
    rows = lambda path, name: t.spark.read.parquet(path).select(F.lit(name).alias("sink"), "event_id", "event_type")
    return rows(a, "archive").unionByName(rows(b, "errors"))


@query("t1_intake_stream", ORACLES["t1_intake"])
def t1(t):
    requests, drain = drained(t, "events", lambda e: job_requests(_Stream(e)))
    rules = intake.SlidingThrottle(2, 2, HOUR_US, DAY_US)
    # the drain's own request waits for the watermark for ever
    return run_to_end(intake_s.intake_stream(requests, rules, intake.TtlLocks(3 * DAY_US)), "t1", (drain,))


@query(
    "t2_state_expiry",
    intake_sql(
        """SELECT org AS organization_id, CASE WHEN now >= last + 3610000000 THEN 0 ELSE coalesce(short, 0) END AS short_held, coalesce(long, 0) AS long_held
        FROM (SELECT org, max(epoch_us(ts)) AS last FROM v GROUP BY org) JOIN w ON last + 259800000000 > now
            OR org IN (SELECT 'org' || user_id FROM events WHERE epoch_us(ts) >= now) LEFT JOIN
          (SELECT org, len(held) AS long, len(list_filter(held, lambda h: h > ts - INTERVAL 1 HOUR)) AS short FROM r
           QUALIFY row_number() OVER (PARTITION BY org ORDER BY rn DESC) = 1) USING (org)""",
        known="w AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 AS now FROM events),",
        window="epoch_us(ts) < (SELECT now FROM w)",
    ),
)
def t2(t):
    """What the stream's state still holds when its watermark, ten minutes behind the last event, stands still: idle
    tenants have no short window after an hour and, unless a request waits, no state after three days, each with a buffer."""
    requests = job_requests(_Stream(table_stream(t.spark, t.sf_dir, "events")))
    rules = intake.SlidingThrottle(2, 2, HOUR_US, DAY_US)
    held = state_at_end(intake_s.intake_stream(requests, rules, intake.TtlLocks(3 * DAY_US)), "t2", "intake")
    window = lambda i: F.size(F.from_json(F.get_json_object("value.saved", f"$[0][{i}]"), "array<bigint>")).cast("long")
    held = held.filter("value.saved IS NOT NULL")  # others only wait
    return held.select("key.organization_id", window(0).alias("short_held"), window(1).alias("long_held"))


class _Stream:
    def __init__(self, events):
        self.events = events


TOLD = "TIMESTAMP '2024-01-16'"


@query(
    "x4_queue_feedback_stream",
    intake_sql(
        OUTCOMES, refused="event_id % 5 = 0", told=f"l.r AND l.t < o.known AND o.ts >= {TOLD}",
        more=f", (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events WHERE ts < {TOLD}) AS known",
    ),
)
def x4_stream(t):
    """Requests in two halves; the queue refuses every fifth, and what it refused of the first half is known when the
    second begins."""
    requests, folder = with_instants(job_requests(t)), new_folder(t.spark, "feedback")
    told = F.lit("2024-01-16 00:00:00").cast("timestamp")
    rules, asked = intake.SlidingThrottle(2, 2, HOUR_US, DAY_US), f"{folder}/requests"
    last = requests.agg(F.max("ts")).first()[0]
    closing = requests.limit(1).withColumn("ts", F.lit(last).cast("timestamp") + F.make_dt_interval(days=F.lit(366)))
    refused = lambda messages, epoch: messages.filter(F.col("request_id").cast("long") % 5 == 0)
    for half in (requests.filter(F.col("ts") < told), requests.filter(F.col("ts") >= told), closing):
        half.write.mode("append").parquet(asked)
        stream = folder_stream(t.spark, asked, requests.schema)
        intake_s.intake_with_queue(stream, rules, intake.TtlLocks(3 * DAY_US), refused, folder, told).awaitTermination()
    return t.spark.read.parquet(f"{folder}/labelled").drop("epoch")


SNAPSHOTS = """(SELECT user_id AS run_id, event_id AS poll, event_type, CAST(props->>'$.k' AS INT) AS k, event_type = 'purchase' AND CAST(props->>'$.k' AS INT) > 80 AS done FROM events)"""


@query(
    "t3_change_stream",
    f"""WITH s AS (SELECT *, lag(poll) OVER w AS prior, sum(done::INT) OVER (PARTITION BY run_id ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM {SNAPSHOTS} WINDOW w AS (PARTITION BY run_id ORDER BY poll)),
      l AS (SELECT *, CASE WHEN NOT done THEN 'syncing' WHEN k % 2 = 1 THEN 'ready' ELSE 'failed' END AS phase FROM s WHERE coalesce(ended, 0) = 0),
      u AS (SELECT *, unnest(range(1, 2 + k % 3)) AS job FROM l),
      j AS (SELECT run_id, poll, prior, job, ['build', 'test', 'deploy'][job] AS name, CASE WHEN job = 1 THEN event_type WHEN (k + job) % 4 < 2 THEN 'queued' ELSE 'in_progress' END AS status FROM u),
      b AS (SELECT j.*, o.status AS before FROM j LEFT JOIN j o ON o.run_id = j.run_id AND o.poll = j.prior AND o.job = j.job)
    SELECT run_id, poll, 'log' AS kind, CASE WHEN before IS NULL THEN 'Job started: ' || name || ' (' || status || ')' ELSE 'Job ' || name || ': ' || status END AS line, 'info' AS level, NULL AS phase FROM b WHERE before IS DISTINCT FROM status
    UNION ALL SELECT run_id, poll, 'status', NULL, NULL, phase FROM l UNION ALL SELECT run_id, poll, 'complete', NULL, NULL, phase FROM l WHERE done""",
)
def t3(t):
    """Polls of runs with one to three jobs, which come and go."""
    k = F.get_json_object("props", "$.k").cast("int")
    done = (F.col("event_type") == "purchase") & (k > 80)
    job = F.col("job_id")
    snapshots = table_stream(t.spark, t.sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("poll"),
        F.when(done, "completed").otherwise("in_progress").alias("run_status"),
        F.when(done, F.when(k % 2 == 1, "success").otherwise("failure")).alias("run_conclusion"),
        "event_type", k.alias("k"), F.posexplode(F.sequence(F.lit(1).cast("long"), 1 + k % 3)).alias("listing_pos", "job_id"),
    ).select(
        "run_id", "poll", "run_status", "run_conclusion", "listing_pos", "job_id",
        F.element_at(F.array(*map(F.lit, ("build", "test", "deploy"))), job.cast("int")).alias("name"),
        F.when(job == 1, F.col("event_type")).when((F.col("k") + job) % 4 < 2, "queued").otherwise("in_progress").alias("status"),
        F.lit(None).cast("string").alias("conclusion"),
    )
    return run_to_end(tracking_s.change_stream(snapshots), "t3")


@query(
    "t4_correlate_stream",
    """WITH p AS (SELECT d.user_id, d.event_id AS dispatch_id, d.ts, min(r.event_id) AS run_id FROM events d
    LEFT JOIN events r ON r.event_type = 'purchase' AND r.user_id = d.user_id AND r.ts BETWEEN d.ts - INTERVAL 30 SECOND AND d.ts + INTERVAL 6 HOUR WHERE d.event_type = 'signup' GROUP BY ALL)
    SELECT *, CASE WHEN run_id IS NULL THEN 'failed' ELSE 'syncing' END AS phase, CASE WHEN run_id IS NULL THEN 'Timed out waiting for GitHub Actions run' END AS message FROM p""",
)
def t4(t):
    d, d_drain = drained(t, "events", lambda e: e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("dispatch_id"), "ts"))
    r, r_drain = drained(
        t, "events",
        lambda e: e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("run_id"), F.col("event_id").alias("listing_pos"), "ts"),
    )
    out = run_to_end(tracking_s.correlate_stream(d, r, "user_id", 30, 6 * 3600), "t4", (d_drain, r_drain))
    return d_drain.rows_only(out, "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("t5_alert_stream", ORACLES["w5_alert_states"])
def t5(t):
    rows, drain = drained(t, "events", lambda e: e.select("event_type", "ts"))
    return run_to_end(metrics_s.alert_stream(rows, "event_type", 3600, 7200, F.col("n") >= 3), "t5", (drain,))


@query("t6_counter_stream", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t6(t):
    rows, drain = drained(t, "events", lambda e: e.select("event_type", "ts"))
    out = run_to_end(metrics_s.counter_stream(rows, "event_type", "1 hour"), "t6", (drain,))
    return drain.rows_only(out, "window_start").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "t6_session_stream",
    """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, s""",
)
def t6b(t):
    rows, drain = drained(t, "events", lambda e: e.select("user_id", "ts"))
    out = run_to_end(metrics_s.session_stream(rows, "user_id", "30 minutes"), "t6b", (drain,))
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")}
    return drain.rows_only(out, "started").withColumns(ntz)


@query("t7_route_stream", f"SELECT * FROM ({ORACLES['f19_route']}) WHERE target IS NOT NULL")
def t7(t):
    out = new_folder(t.spark, "routes")
    stream = table_stream(t.spark, t.sf_dir, "events").select(
        "event_id", "event_type", F.when(F.col("user_id") < 75, "shop").otherwise("site").alias("source")
    )
    # a folder for each micro-batch, so that one that is tried again replaces itself
    to = lambda target: lambda df, epoch: df.select("event_id").write.mode("overwrite").parquet(f"{out}/target={target}/epoch={epoch}")
    sinks = {target: to(target) for target in ("billing", "incidents", "audit")}
    metrics_s.route_stream(stream, ROUTES, sinks, out + "-checkpoint").awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "target")


@query(
    "t8_job_state_stream",
    """WITH e AS (SELECT conv_id AS job_id, TIMESTAMP '2024-01-01' + turn * INTERVAL 1 HOUR AS ts, turn, CASE WHEN turn = 0 THEN 'PENDING' WHEN role = 'user' AND turn >= 4 THEN CASE WHEN conv_id % 3 = 0 THEN 'CANCELLED' ELSE 'COMPLETED' END ELSE 'RUNNING' END AS status FROM conversations),
      b AS (SELECT *, min(ts) OVER (PARTITION BY job_id) + CASE WHEN job_id % 2 = 0 THEN INTERVAL 10 HOUR ELSE INTERVAL 3 HOUR END AS deadline FROM e),
      f AS (SELECT job_id, min(CASE WHEN status IN ('COMPLETED', 'CANCELLED') AND ts <= deadline THEN ts END) AS done, min(deadline) AS deadline, min(ts) AS s, min(CASE WHEN status = 'RUNNING' THEN ts END) AS r, min(CASE WHEN status = 'PENDING' THEN ts END) AS p FROM b GROUP BY 1)
    SELECT job_id, 'PENDING' AS status, p AS ts FROM f WHERE p IS NOT NULL
    UNION ALL SELECT job_id, 'RUNNING', r FROM f WHERE r <= least(coalesce(done, deadline), deadline) AND r IS NOT NULL
    UNION ALL SELECT job_id, CASE WHEN done IS NULL THEN 'TIMEOUT' WHEN job_id % 3 = 0 THEN 'CANCELLED' ELSE 'COMPLETED' END, coalesce(done, deadline) FROM f""",
)
def t8(t):
    ended = (F.col("role") == "user") & (F.col("turn") >= 4)
    status = F.when(F.col("turn") == 0, "PENDING").when(ended, F.when(F.col("conv_id") % 3 == 0, "CANCELLED").otherwise("COMPLETED")).otherwise("RUNNING")
    rows, drain = drained(t, "conversations", lambda c: c.select(
        F.col("conv_id").alias("job_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 3600).alias("ts"),
        status.alias("status"),
        F.when(F.col("conv_id") % 2 == 0, 36000).otherwise(10800).alias("timeout_seconds"),
    ))
    out = run_to_end(tracking_s.job_state_stream(rows), "t8", (drain,))
    return drain.rows_only(out, "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("t9_tail_stream", "SELECT conv_id, turn, text FROM conversations")
def t9(t):
    return run_to_end(tracking_s.tail_stream(table_stream(t.spark, t.sf_dir, "conversations"), "conv_id", "turn", "text"), "t9")


def summarise():
    """Stands in for a model: built once per task, called with batches of prompts."""
    return lambda prompts: [f"{len(p)} characters: {p[:20]}" for p in prompts]


@query(
    "x1_predict",
    "SELECT doc_id, md5(text) AS prompt, length(text) || ' characters: ' || substring(text, 1, 20) AS generated_text, 'stub' AS model FROM documents",
)
def x1(t):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    out = inference.predict(t.documents.select("doc_id", "text"), "text", summarise, "stub", as_of, t.spark.sparkContext.defaultParallelism, ["doc_id"])
    return out.select("doc_id", F.md5("text").alias("prompt"), "generated_text", "model")


def analyse():
    return lambda prompts: ["" if "Error: es" in p else f"Cause seen in {len(p)} characters." for p in prompts]


# length of the fixed text of the prompt around repo, error and logs
FRAME = len(inference.PROMPT.replace("{repo}", "").replace("{error}", "").replace("{logs}", ""))


@query(
    "x2_triage",
    f"""WITH f AS (SELECT doc_id, md5(text) AS sha, source AS repo, lang, CASE WHEN lang = 'fr' AND doc_id % 2 = 0 THEN '' WHEN lang = 'fr' THEN 'nobody' ELSE 'u' || doc_id || '@example.com' END AS email,
        'Cause seen in ' || ({FRAME} + length(source) + length(lang) + least(length(text), 5000)) || ' characters.' AS analysis FROM documents),
      g AS (SELECT f.*, l.doc_id AS uid FROM f LEFT JOIN labels l ON l.doc_id = f.doc_id),
      c AS (SELECT *, CASE WHEN email = '' THEN 'MISSING_REQUIRED_FIELDS' WHEN email = 'nobody' THEN 'INVALID_EMAIL_FORMAT' WHEN lang = 'es' THEN 'OLLAMA_SERVICE_ERROR' WHEN doc_id % 7 = 0 THEN 'SLACK_SERVICE_ERROR' WHEN uid IS NULL THEN 'SLACK_USER_NOT_FOUND' END AS code FROM g)
    SELECT doc_id, code, CASE code WHEN 'MISSING_REQUIRED_FIELDS' THEN 400 WHEN 'INVALID_EMAIL_FORMAT' THEN 400 WHEN 'OLLAMA_SERVICE_ERROR' THEN 503 WHEN 'SLACK_SERVICE_ERROR' THEN 503 WHEN 'SLACK_USER_NOT_FOUND' THEN 404 ELSE 200 END AS http_status,
      CASE WHEN email = '' THEN 'author_email' ELSE '' END AS missing_fields, CASE WHEN code IS NULL THEN uid END AS recipient, CASE WHEN code IS NULL THEN analysis END AS analysis_preview,
      CASE WHEN code IS NULL THEN '🚨 *Build Failed* - `' || repo || '`' || chr(10) || chr(10) || '*Commit:* `' || substring(sha, 1, 7) || '`' || chr(10) || chr(10) || '*Analysis:*' || chr(10) || analysis || chr(10) || chr(10) || '<https://github.com/' || repo || '/commit/' || sha || '|View Commit>' END AS message
    FROM c""",
)
def x2(t):
    user = F.concat(F.lit("u"), F.col("doc_id"), F.lit("@example.com"))
    email = F.when((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0), " ").when(F.col("lang") == "fr", "nobody").otherwise(user)
    failures = t.documents.select(
        "doc_id", F.md5("text").alias("commit_sha"), email.alias("author_email"), F.col("source").alias("repo"), F.col("text").alias("logs"), F.col("lang").alias("error")
    )
    people = t.labels.select(user.alias("email"), F.col("doc_id").alias("user_id"))
    out = inference.triage(failures, people, analyse, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), F.col("doc_id") % 7 == 0)
    return out.select("doc_id", "code", "http_status", "missing_fields", "recipient", "analysis_preview", "message")
