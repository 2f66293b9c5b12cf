"""Sources and sinks."""

import uuid

from pyspark.sql import functions as F

from fleetlens.plans.registry import query
from fleetlens.session import checkpoint_dir
from fleetlens.sources import files, queue
from fleetlens.sources.tables import scan


def scratch(t, name):
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def s1(t):
    rows = scan(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey"])
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(
    "s3_queue_messages",
    "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
)
def s3(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return queue.from_messages(queue.to_messages(rows, "o_custkey"), rows.schema)


@query(
    "s4_decode_envelope",
    """SELECT event_id,
      CASE event_type WHEN 'click' THEN 'payload' WHEN 'view' THEN 'parameters' END AS config_source,
      CASE WHEN event_type IN ('click', 'view') THEN CAST(props->>'$.k' AS INTEGER) END AS k,
      CASE WHEN event_type = 'error' THEN 'failed to unmarshal job envelope'
           WHEN event_type NOT IN ('click', 'view') THEN 'no config found in payload or parameters' END AS error
    FROM events""",
)
def s4(t):
    body = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("job_id"),
            F.col("event_type").alias("job_type"),
            F.when(F.col("event_type") == "click", F.col("props")).otherwise("").alias("payload"),
            F.when(F.col("event_type") == "view", F.create_map(F.lit("config"), F.col("props"))).alias("parameters"),
        )
    )
    broken = F.col("event_type") == "error"
    messages = t.events.select("event_id", F.when(broken, F.lit("{broken")).otherwise(body).alias("value"))
    out = queue.decode_envelope(messages, config_schema="struct<k: int>")
    return out.select("event_id", "config_source", F.col("config.k").alias("k"), "error")


@query("s5_sample_results", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def s5(t):
    path = scratch(t, "results")
    files.write_results(t.documents.select("doc_id", "lang", "n_chars"), path)
    return files.sample_results(t.spark, path, 10, ["doc_id"])


@query(
    "s6_report",
    """SELECT 1 AS section, '| ' || p_brand || ' | ' || p_type || ' | ' || p_name || ' | ' || p_size || ' |' AS line FROM part
    UNION ALL SELECT 0, unnest(['Image Inventory', 'Last Updated: 2024-01-31 00:00:00 UTC', '|| p_brand || p_type || p_name || p_size ||'])
    UNION ALL SELECT 2, 'Total images found: ' || count(*) FROM part""",
)
def s6(t):
    return files.report_lines(t.part, ["p_brand", "p_type", "p_name", "p_size"], "Image Inventory", "2024-01-31 00:00:00 UTC")


@query(
    "s7_exposition",
    """SELECT 'events_total{type="' || event_type || '",user="' || user_id || '"} ' || count(*) AS line
    FROM events GROUP BY event_type, user_id""",
)
def s7(t):
    samples = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("value"))
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    return files.to_exposition(samples.select(F.lit("events_total").alias("name"), labels.alias("labels"), "value"))


@query(
    "s8_ingest_scrapes",
    """SELECT 'events_total' AS name, event_type AS type, CAST(user_id AS VARCHAR) AS user, CAST(count(*) AS DOUBLE) AS value
    FROM events GROUP BY event_type, user_id""",
)
def s8(t):
    parsed = files.ingest_scrapes(s7(t).withColumnRenamed("line", "value"))
    return parsed.select("name", F.col("labels")["type"].alias("type"), F.col("labels")["user"].alias("user"), "value")


@query(
    "s9_objects",
    """SELECT p_brand AS namespace, 'part-' || p_partkey AS name, 'registry/' || p_type || ':' || p_size AS image
    FROM part WHERE p_size > 25""",
)
def s9(t):
    """Cluster objects written as JSON lines, read back by kind."""
    container = F.struct(F.lit("main").alias("name"), F.concat_ws(":", F.concat(F.lit("registry/"), "p_type"), "p_size").alias("image"))
    objects = t.part.select(
        F.when(F.col("p_size") > 25, "Pod").otherwise("Job").alias("kind"),
        F.struct(F.concat(F.lit("part-"), "p_partkey").alias("name"), F.col("p_brand").alias("namespace")).alias("metadata"),
        F.struct(F.array(container).alias("containers")).alias("spec"),
    )
    path = scratch(t, "objects")
    objects.write.json(path)
    pods = files.read_objects(t.spark, path, "Pod")
    return pods.select("metadata.namespace", "metadata.name", F.col("spec.containers")[0]["image"].alias("image"))


@query(
    "s10_tenant_layout",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority AS organization_id FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def s10(t):
    path = scratch(t, "orgs")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderpriority").alias("organization_id"))
    files.write_tenant_partitioned(rows, path, "organization_id", ["o_orderkey"])
    return files.read_tenant(t.spark, path, "organization_id", "1-URGENT")


@query(
    "s12_alert_record",
    """WITH h AS (SELECT date_trunc('hour', ts) AS h, event_type AS service_name, count(*) AS requests, max(user_id) AS top_user
               FROM events GROUP BY 1, 2)
    SELECT service_name, strftime(h, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
      '{"alert":{"name":"HighTraffic","timestamp":"' || strftime(h, '%Y-%m-%dT%H:%M:%SZ') || '","severity":"critical","namespace":"monitoring","service_name":"'
      || service_name || '","metrics":{"requests":' || requests || ',"top_user":' || top_user || '}}}' AS record
    FROM h WHERE requests >= 4""",
)
def s12(t):
    hourly = t.events.groupBy(F.date_trunc("hour", "ts").alias("h"), F.col("event_type").alias("service_name")).agg(
        F.count(F.lit(1)).alias("requests"), F.max("user_id").alias("top_user")
    )
    rows = hourly.filter("requests >= 4").withColumn("timestamp", F.date_format("h", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    record = files.alert_record("HighTraffic", "critical", "monitoring", ["requests", "top_user"])
    return rows.select("service_name", "timestamp", record.alias("record"))
