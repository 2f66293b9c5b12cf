"""Given tables and the operational views drawn from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.segments import ROWS_PER_TASK, Scan, running
from fleetlens.session import use_utc


def scan(spark: SparkSession, path: str, order_by: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.orderBy(*order_by) if order_by else df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 10) -> DataFrame:
    """Relational source, read in parallel ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, rows_per_task: int = ROWS_PER_TASK):
        use_utc(spark)
        self.spark, self.sf_dir, self.rows_per_task = spark, str(sf_dir).rstrip("/"), rows_per_task

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def requests(self) -> DataFrame:
        """One row per request: tenant, instant, outcome, latency, status code number."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            F.col("event_id").alias("request_id"),
            F.col("user_id").alias("organization_id"),
            "ts",
            "event_type",
            (F.col("event_type") != "error").alias("ok"),
            F.col("value").alias("latency_ms"),
            k.alias("k"),
            ((k % 5 + 1) * 100 + k).cast("int").alias("code"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        """A counter per event type: the running number of its events."""
        rows = self.events.select(F.col("event_type").alias("series"), "ts", "event_id")
        return running(
            rows, ["series"], ["ts", "event_id"], {"value": Scan("row_number")}, self.rows_per_task
        ).withColumn("value", F.col("value").cast("double"))

    @cached_property
    def jobs(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("job_id"),
            F.col("o_custkey").alias("tenant"),
            F.expr("CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RUNNING' ELSE 'COMPLETED' END").alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def spans(self) -> DataFrame:
        """Orders as root spans; every distinct line is a child span."""
        root = self.orders.select(
            F.col("o_orderkey").alias("trace_id"),
            F.concat(F.lit("o"), F.col("o_orderkey")).alias("span_id"),
            F.lit(None).cast("string").alias("parent_id"),
            F.col("o_orderpriority").alias("name"),
            F.col("o_orderdate").alias("start"),
            F.col("o_orderdate").alias("end"),
        )
        child = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("trace_id"),
            F.concat_ws("-", F.lit("l"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("span_id"),
            F.concat(F.lit("o"), F.col("l_orderkey")).alias("parent_id"),
            F.concat(F.lit("line-"), F.col("l_linenumber")).alias("name"),
            F.col("o_orderdate").alias("start"),
            F.col("l_shipdate").alias("end"),
        )
        return root.unionByName(child)
