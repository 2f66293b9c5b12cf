"""Scalar functions over whole columns."""

from pyspark.sql import functions as F

from fleetlens.functions import ids, text
from fleetlens.plans.registry import query


@query(
    "n1_job_signature",
    "SELECT conv_id, turn, sha256(text || role || '' || 'a' || conv_id || 'b' || turn) AS signature FROM conversations",
)
def n1(t):
    params = F.create_map(F.lit("b"), F.col("turn").cast("string"), F.lit("a"), F.col("conv_id").cast("string"))
    return t.conversations.select("conv_id", "turn", ids.job_signature(F.col("text"), F.col("role"), F.lit(""), params).alias("signature"))


@query(
    "n2_keys",
    "SELECT event_id, 'mcp:job:' || user_id || ':' || event_type || ':' || sha256(props || event_type) AS lock_key, 'throttle:' || user_id || ':minute' AS minute_key FROM events",
)
def n2(t):
    org = F.col("user_id").cast("string")
    sig = ids.job_signature(F.col("props"), F.col("event_type"), F.lit(""))
    return t.events.select("event_id", ids.lock_key(org, F.col("event_type"), sig).alias("lock_key"), ids.throttle_key(org, "minute").alias("minute_key"))


@query(
    "n3_quantity",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_size * 1048576.0::DOUBLE WHEN 'PROMO' THEN round(p_size * 0.001::DOUBLE, 6) WHEN 'STANDARD' THEN p_size * 1073741824.0::DOUBLE WHEN 'LARGE' THEN p_size * 1000.0::DOUBLE WHEN 'SMALL' THEN p_size::DOUBLE END AS amount FROM part""",
)
def n3(t):
    unit = F.expr("CASE p_type WHEN 'ECONOMY' THEN 'Mi' WHEN 'PROMO' THEN 'm' WHEN 'STANDARD' THEN 'Gi' WHEN 'LARGE' THEN 'k' WHEN 'SMALL' THEN '' ELSE ' bad' END")
    return t.part.select("p_partkey", F.round(text.quantity(F.concat(F.col("p_size").cast("string"), unit)), 6).alias("amount"))


@query(
    "n4_names",
    "SELECT c_custkey, 'tenant-' || c_custkey AS namespace, 'tenant-' || c_custkey || '-role' AS role, 'orgs/' || c_custkey AS prefix FROM customer",
)
def n4(t):
    org = F.col("c_custkey").cast("string")
    return t.customer.select(
        "c_custkey", ids.tenant_namespace(org).alias("namespace"), ids.tenant_role(org).alias("role"), ids.tenant_prefix(org).alias("prefix")
    )


@query(
    "n5_path_tail",
    "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN list_extract(string_split(url, '/'), -1) ELSE url END AS tail, suffix(url, 'top') AS matches FROM pages",
)
def n5(t):
    return t.pages.select("page_id", text.path_tail(F.col("url"), "https://").alias("tail"), text.path_matches(F.col("url"), F.lit("top")).alias("matches"))


@query("n6_instants", "SELECT o_orderkey, o_orderdate AS parsed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS shown FROM orders")
def n6(t):
    shown = text.rfc3339(F.col("o_orderdate").cast("timestamp"))
    return t.orders.select("o_orderkey", text.instant(shown).cast("timestamp_ntz").alias("parsed"), shown.alias("shown"))


@query("n7_is_email", "SELECT doc_id, contains(text, '@') AS is_email FROM documents")
def n7(t):
    return t.documents.select("doc_id", text.is_email(F.col("text")).alias("is_email"))


@query(
    "n8_truncate",
    "SELECT doc_id, md5(substring(text, 1, 5000)) AS body, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview, substring(md5(text), 1, 7) AS short FROM documents",
)
def n8(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.md5(text.truncate(c)).alias("body"), text.preview(c).alias("preview"), text.short_id(F.md5(c)).alias("short"))


@query(
    "n9_split_list",
    "SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(url, '/', ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM pages",
)
def n9(t):
    return t.pages.select("page_id", F.array_join(text.split_list(F.replace("url", F.lit("/"), F.lit(" , "))), "|").alias("parts"))


@query(
    "n10_int_or",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN -1 ELSE CAST(props->>'$.k' AS INTEGER) END AS n, CASE WHEN event_type <> 'click' AND CAST(props->>'$.k' AS INTEGER) > 0 THEN CAST(props->>'$.k' AS INTEGER) ELSE 300 END AS ttl FROM events""",
)
def n10(t):
    k = F.when(F.col("event_type") == "click", F.col("props")).otherwise(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", text.int_or(k, -1).alias("n"), text.int_or(k, 300, positive=True).alias("ttl"))


@query(
    "n11_first_non_empty",
    "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment WHEN c_acctbal > 0 THEN c_name ELSE '' END AS name FROM customer",
)
def n11(t):
    rich = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise("")
    some = F.when(F.col("c_acctbal") > 0, F.col("c_name"))
    return t.customer.select("c_custkey", text.first_non_empty(rich, some).alias("name"))


@query(
    "n12_bearer",
    "SELECT c_custkey, c_name AS token, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_name END AS strict FROM customer",
)
def n12(t):
    scheme = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'Bearer ' WHEN 'MACHINERY' THEN 'bEARER ' ELSE '' END")
    raw = F.concat(scheme, F.col("c_name"), F.lit(" "))
    return t.customer.select("c_custkey", text.bearer_token(raw).alias("token"), text.bearer_only(raw).alias("strict"))


@query("n13_level", "SELECT doc_id, CASE WHEN contains(lower(text), 'fail') THEN 'error' ELSE 'info' END AS level FROM documents")
def n13(t):
    from fleetlens.operators.tracking import level_of

    return t.documents.select("doc_id", level_of(F.col("text")).alias("level"))


@query("n14_extract_all", """SELECT event_id, event_type || ',' || 'u' || user_id AS jobs FROM events""")
def n14(t):
    body = F.concat(
        F.lit('[{"job":"'), F.col("event_type"), F.lit('","x":1},{"job": "u'), F.col("user_id"), F.lit('"},'), F.col("props"), F.lit("]")
    )
    return t.events.select("event_id", F.array_join(text.extract_all(body, "job"), ",").alias("jobs"))


@query("n15_json", """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS encoded, CAST(props->>'$.k' AS INTEGER) AS k FROM events""")
def n15(t):
    return t.events.select(
        "event_id", F.to_json(F.struct("event_type", "user_id")).alias("encoded"), F.from_json("props", "k int")["k"].alias("k")
    )


@query(
    "n16_text_filters",
    "SELECT p_partkey, upper(p_name) AS shout, length(p_name) AS n, replace(p_name, ' ', '-') AS joined, string_split(p_name, ' ')[1] AS first, CASE WHEN p_size > 25 THEN p_type ELSE 'none' END AS kind FROM part",
)
def n16(t):
    words = F.split("p_name", " ")
    kind = F.when(F.col("p_size") > 25, F.col("p_type"))
    return t.part.select(
        "p_partkey", F.upper("p_name").alias("shout"), F.length("p_name").cast("long").alias("n"), F.array_join(words, "-").alias("joined"),
        F.element_at(words, 1).alias("first"), F.coalesce(kind, F.lit("none")).alias("kind"),
    )


@query("n16_random_item")
def n16b(t):
    """A random word per row; the seed makes it repeatable but not expressible in other SQL."""
    return t.part.select("p_partkey", F.element_at(F.shuffle(F.split("p_name", " "), 7), 1).alias("word"))


@query(
    "n17_first_line",
    "SELECT doc_id, coalesce(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]'))[1], '') AS line FROM documents",
)
def n17(t):
    return t.documents.select("doc_id", text.first_line(F.col("text"), "[0-9]").alias("line"))


@query(
    "n18_field",
    r"""SELECT doc_id, coalesce(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[2], '') AS second, split_part(text, '.', 1) AS head FROM documents""",
)
def n18(t):
    flat = F.regexp_replace("text", r"\s+", " ")
    return t.documents.select("doc_id", text.field(flat, 2).alias("second"), text.field(F.col("text"), 1, ".").alias("head"))


@query("n19_seconds", "SELECT o_orderkey, epoch(TIMESTAMP '2001-09-01' - o_orderdate) AS seconds FROM orders")
def n19(t):
    return t.orders.select("o_orderkey", text.seconds_between(F.col("o_orderdate"), F.lit("2001-09-01 00:00:00").cast("timestamp_ntz")).alias("seconds"))


@query("n20_metric_name", "SELECT 'testapp_' || event_type AS name, count(*) AS n FROM events GROUP BY 1")
def n20(t):
    return t.events.groupBy(text.metric_name(F.col("event_type")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("n21_copy_map", "SELECT event_id, CASE WHEN event_type <> 'view' THEN '{\"k\":\"' || (props->>'$.k') || '\"}' END AS parameters FROM events")
def n21(t):
    m = F.when(F.col("event_type") != "view", F.from_json("props", "map<string,string>"))
    return t.events.select("event_id", F.to_json(m).alias("parameters"))


@query(
    "n22_fill",
    "SELECT doc_id, 'Repo: ' || source || chr(10) || 'Error: ' || lang || chr(10) || 'Logs:' || chr(10) || substring(text, 1, 5000) AS prompt FROM documents",
)
def n22(t):
    prompt = text.fill("Repo: {repo}\nError: {error}\nLogs:\n{logs}", repo=F.col("source"), error=F.col("lang"), logs=text.truncate(F.col("text")))
    return t.documents.select("doc_id", prompt.alias("prompt"))


@query("n23_random_id")
def n23(t):
    return t.events.select("event_id", ids.random_id().alias("id"))


@query("n23_stable_id", "SELECT event_id, sha256(event_id || '|' || user_id) AS id FROM events")
def n23b(t):
    return t.events.select("event_id", ids.stable_id("event_id", "user_id").alias("id"))


@query("n24_service_names", "SELECT DISTINCT p_brand AS service FROM part WHERE p_size > 10")
def n24(t):
    raw = t.part.select(F.when(F.col("p_size") > 10, F.concat("p_brand", F.lit("-service"))).otherwise(F.col("p_brand")).alias("c"))
    return raw.select(text.service_name(F.col("c")).alias("service")).filter("service is not null").distinct()
