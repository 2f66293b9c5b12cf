"""Set operations, unnesting, reports, upserts and updates."""

from pyspark.sql import functions as F

from fleetlens.operators import cluster, relations
from fleetlens.plans.registry import query


@query(
    "u1_union_kinds",
    """SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation""",
)
def u1(t):
    return relations.union_kinds(
        customer=t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        supplier=t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        nation=t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
    )


@query("u2_replicate", "SELECT p_partkey, c::INT AS copy FROM part, range(1, 1 + (SELECT count(*) FROM orders) // (SELECT count(*) FROM part)) r(c)")
def u2(t):
    return relations.replicate(t.part.select("p_partkey"), t.orders.count())


@query("u3_distinct_sorted", "SELECT DISTINCT p_brand, p_type FROM part")
def u3(t):
    return relations.distinct_sorted(t.part, ["p_brand", "p_type"])


@query(
    "u4_explode_containers",
    """SELECT vec_id, position::INT AS position, value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings WHERE label <> 0)""",
)
def u4(t):
    """Rows without a list give no row."""
    numbered = F.transform("embedding", lambda x, i: F.struct(i.alias("position"), x.cast("double").alias("value")))
    objects = t.embeddings.select("vec_id", F.when(F.col("label") != 0, numbered).alias("items"))
    return cluster.explode_containers(objects, "items").select("vec_id", "container.position", "container.value")


@query(
    "u5_explode_map",
    """SELECT event_id, 'tags' AS key, event_type AS item FROM events UNION ALL SELECT event_id, 'ids', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'ids', props->>'$.k' FROM events""",
)
def u5(t):
    m = F.create_map(
        F.lit("tags"), F.array("event_type"), F.lit("ids"), F.array(F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    )
    return cluster.explode_map(t.events.select("event_id", m.alias("m")), "m")


@query(
    "u6_build_report",
    """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 200 AS part FROM conversations)
    SELECT conv_id, part, count(*) AS sections, string_agg('=== ' || upper(role) || ' ===' || chr(10) || text, chr(10) ORDER BY turn) AS report FROM p GROUP BY 1, 2""",
)
def u6(t):
    return relations.build_report(t.conversations, "conv_id", ["turn"], F.upper("role"), F.col("text"), rows_per_task=t.rows_per_task)


# up to three changes meet in one key; the last, by the customer they come from, counts
CHANGES = """(SELECT c_custkey + 750 - c_custkey % 3 AS c_custkey, max_by(c_name || '*', c_custkey) AS c_name, max_by(c_nationkey, c_custkey) AS c_nationkey
      FROM customer WHERE c_acctbal > 5000 GROUP BY 1)"""


def changes(t):
    return t.customer.filter("c_acctbal > 5000").select(
        (F.col("c_custkey") + 750 - F.col("c_custkey") % 3).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"),
        "c_nationkey", F.col("c_custkey").alias("seq"),
    )


@query(
    "u7_upsert",
    f"""SELECT coalesce(x.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN x.c_custkey IS NULL THEN b.c_name ELSE x.c_name END AS c_name, CASE WHEN x.c_custkey IS NULL THEN b.c_nationkey ELSE x.c_nationkey END AS c_nationkey
    FROM customer b FULL JOIN {CHANGES} x ON b.c_custkey = x.c_custkey""",
)
def u7(t):
    return relations.upsert(t.customer.select("c_custkey", "c_name", "c_nationkey"), changes(t), "c_custkey", ["seq"])


@query(
    "u8_patch",
    """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN NULL WHEN c_acctbal > 0 THEN c_name || '!' ELSE c_name END AS c_name,
      CASE WHEN c_acctbal > 0 AND c_acctbal <= 5000 THEN sha256('pw' || c_custkey) ELSE 'old' END AS hashed_password, CASE WHEN c_acctbal > 0 AND c_custkey % 4 = 0 THEN 'LATE' ELSE c_mktsegment END AS c_mktsegment,
      CASE WHEN c_acctbal > 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM customer""",
)
def u8(t):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    base = t.customer.select("c_custkey", "c_name", F.lit("old").alias("hashed_password"), "c_mktsegment", day("2024-01-01 00:00:00").alias("updated_at"))
    rich = F.col("c_acctbal") > 5000
    patches = t.customer.filter("c_acctbal > 0").select(
        "c_custkey",
        F.when(rich, F.array(F.lit("c_name"))).otherwise(F.array(F.lit("c_name"), F.lit("password"))).alias("set_fields"),
        F.when(~rich, F.concat("c_name", F.lit("!"))).alias("c_name"),
        F.concat(F.lit("pw"), F.col("c_custkey")).alias("password"),
        F.lit("ignored").alias("c_mktsegment"), F.lit(2).alias("seq"),
    )
    # an earlier patch of the name that is overwritten, and a later one of another field
    other = lambda rows, field, value, seq: rows.select(
        "c_custkey", F.array(F.lit(field)).alias("set_fields"), F.lit(value).alias("c_name"), F.lit(None).cast("string").alias("password"),
        F.lit(value).alias("c_mktsegment"), F.lit(seq).alias("seq"),
    )
    positive = t.customer.filter("c_acctbal > 0")
    patches = patches.unionByName(other(positive.filter("c_custkey % 5 = 0"), "c_name", "early", 1))
    patches = patches.unionByName(other(positive.filter("c_custkey % 4 = 0"), "c_mktsegment", "LATE", 3))
    return relations.patch(
        base, patches, "c_custkey", day("2024-02-01 00:00:00"), password="password", hashed="hashed_password", order=["seq"]
    )


@query(
    "u9_update_where",
    f"""SELECT 'row' AS part, b.c_custkey, CASE WHEN x.c_custkey IS NULL THEN b.c_name ELSE x.c_name END AS c_name, false AS changed FROM customer b LEFT JOIN {CHANGES} x ON b.c_custkey = x.c_custkey
    UNION ALL SELECT 'report', x.c_custkey, NULL, b.c_custkey IS NOT NULL FROM {CHANGES} x LEFT JOIN customer b ON b.c_custkey = x.c_custkey""",
)
def u9(t):
    rows, report = relations.update_where(t.customer.select("c_custkey", "c_name"), changes(t), "c_custkey", "c_name", ["seq"])
    return rows.withColumns({"part": F.lit("row"), "changed": F.lit(False)}).unionByName(report.withColumn("part", F.lit("report")), allowMissingColumns=True)


@query(
    "u10_delete_where",
    f"""SELECT 'row' AS part, c_custkey, false AS changed FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {CHANGES})
    UNION ALL SELECT 'report', x.c_custkey, b.c_custkey IS NOT NULL FROM {CHANGES} x LEFT JOIN customer b ON b.c_custkey = x.c_custkey""",
)
def u10(t):
    rows, report = relations.delete_where(t.customer.select("c_custkey"), changes(t), "c_custkey")
    return rows.withColumns({"part": F.lit("row"), "changed": F.lit(False)}).unionByName(report.withColumn("part", F.lit("report")), allowMissingColumns=True)
