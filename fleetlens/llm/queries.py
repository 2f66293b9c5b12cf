"""One query for each operator, over its whole table, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import documents, remainder
from fleetlens.llm.registry import query


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm.tokens import count_tokens

    counted = count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm.packing import best_fit, pieces

    return best_fit(pieces(documents(spark, sf_dir)))


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm import quality

    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.score(docs, quality_weights(spark, docs, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def quality_weights(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Weights learned from the labelled ids whose remainder by 3 is not 1."""
    from fleetlens.llm import quality

    labels = documents(spark, sf_dir, "labels")
    allowed = remainder(F.col("doc_id"), 3) != 1
    return quality.train(quality.sample_of(docs.select("doc_id", "text"), labels, "quality", allowed))


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm import quality, rules

    docs = documents(spark, sf_dir).select("doc_id", "text")
    allowed = remainder(F.col("doc_id"), 3) != 1
    sample = quality.sample_of(docs, documents(spark, sf_dir, "labels"), "quality", allowed)
    return rules.judge(docs, rules.train(sample)).select("doc_id", *rules.COUNTS, "base_failed", "kept")


@query(
    "op1_exact_top_k",
    """
    WITH v AS (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS n FROM s
    )
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
)
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm.search import top_k

    return top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm.simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir))
    hexadecimal = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm.lm import score

    doc_id = F.col("doc_id")
    # the learning documents with remainder 1 (a ninth of them) are the deleted part
    scored = score(documents(spark, sf_dir), remainder(doc_id, 10) != 0, remainder(doc_id, 10) == 1)
    return scored.withColumn("held_out", F.coalesce(remainder(doc_id, 10) == 0, F.lit(False))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op5_suffix_array_dedup")
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm.repeats import repeated, sha256

    return sha256(repeated(documents(spark, sf_dir)))


@query("op6_source_mixing")
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm.mixing import mix_sources

    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "epoch", "block", "slot")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm.language import identify, learn

    languages, table = learn(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    return identify(documents(spark, sf_dir, "pages"), languages, table)


#: The contract's pattern; ownership follows it. RE2 splits and extracts at the same matches.
_PIECES = """
    SELECT row, source, repository, {k} AS kind, unnest(range(1, len(hits) + 1)) AS i,
           unnest(hits) AS hit, list_transform(string_split_regex(text, '{p}'), lambda g: length(g)) AS gaps,
           list_transform(hits, lambda h: length(h)) AS sizes
    FROM (SELECT *, regexp_extract_all(text, '{p}') AS hits FROM d)
"""


def _secrets_sql() -> str:
    from fleetlens.llm.secrets import KINDS, LEAST_VALUE, PATTERNS

    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    kinds = " UNION ALL ".join(_PIECES.format(k=i, p=quoted[k]) for i, k in enumerate(KINDS))
    random = """length(regexp_replace(value, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) >= 3
                AND len(list_distinct(string_split(value, ''))) >= 10"""
    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    joined = f"string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = {i}), 0) AS n_{k}" for i, k in enumerate(KINDS))
    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, source, (source, lang) AS repository
        FROM documents
    ), p AS ({kinds}), v AS (
        SELECT row, source, repository, kind, CAST(list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS BIGINT) AS e,
               e - length(hit) AS s, CASE WHEN kind = 0 THEN regexp_extract(hit, '{quoted["assign"]}', 2) ELSE hit END AS value
        FROM p
    ), c AS (
        SELECT *, {random} AS random FROM v
        WHERE CASE kind WHEN 0 THEN length(value) >= {LEAST_VALUE} WHEN 3 THEN {random} ELSE TRUE END
    ), o AS (
        SELECT value, count(DISTINCT coalesce(source, '\0')) AS owners FROM c GROUP BY value
    ), j AS (
        SELECT c.*, CASE WHEN owners > 1 THEN 'example' WHEN random THEN 'live' ELSE 'plain' END AS verdict
        FROM c JOIN o USING (value)
    ), t AS (
        SELECT * FROM j WHERE kind < 3 OR (verdict = 'live' AND NOT EXISTS (
            SELECT 1 FROM c b WHERE b.row = j.row AND b.kind < 3 AND b.s < j.e AND j.s < b.e))
    ), g AS (
        SELECT row, {counts}, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example,
               {joined} FILTER (kind < 3) AS base, {joined} AS spans
        FROM t GROUP BY row
    )
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*KINDS, "live", "example"))},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (row)
    """


@query("op13_secret_scan", _secrets_sql())
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm import secrets

    # the table has no repositories: an owner's documents of one language stand for one
    return secrets.report(
        *secrets.scan(documents(spark, sf_dir), F.col("source"), F.struct(F.col("source").alias("owner"), "lang"))
    )


def cycled(doc_id: Column, text: Column) -> Column:
    """Texts with the repetitions of op11's contract: by their ids, a tenth go on in a cycle of their own words."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(crc / 10)
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    n = F.nullif(F.size(words), F.lit(0))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.slice(F.concat(F.slice(words, F.lit(1), a), cycle), F.lit(1), n)
    return F.when((crc % 10 == 0) & n.isNotNull(), F.array_join(planted, " ")).otherwise(text)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm.periods import highest, periodic_runs

    docs = documents(spark, sf_dir).select("doc_id", cycled(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs, carry=["doc_id"]).withColumn("best", highest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.llm.whitening import whiten

    return whiten(documents(spark, sf_dir, "embeddings"))
