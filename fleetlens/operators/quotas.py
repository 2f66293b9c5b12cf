"""Plan tiers, quantities, and usage against quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import quantity

# fixed values: quota per plan tier
TIER_COLUMNS = (
    "tier string, requests_cpu string, requests_memory string, limits_cpu string, limits_memory string, "
    "pvcs int, services int, deployments int, statefulsets int"
)
TIERS = [
    ("FREE", "2", "4Gi", "4", "8Gi", 5, 10, 5, 2),
    ("STARTER", "5", "10Gi", "10", "20Gi", 10, 20, 10, 5),
    ("PRO", "20", "40Gi", "40", "80Gi", 30, 50, 25, 10),
    ("ENTERPRISE", "100", "200Gi", "200", "400Gi", 100, 200, 100, 50),
]
QUANTITIES = ["requests_cpu", "requests_memory", "limits_cpu", "limits_memory"]


def tier_table(spark) -> DataFrame:
    t = spark.createDataFrame(TIERS, TIER_COLUMNS)
    return t.withColumns({c: quantity(F.col(c)) for c in QUANTITIES})


def with_quota(accounts: DataFrame, tier: str) -> DataFrame:
    """Quota columns by tier; an unknown tier becomes an error. The tier table has four rows."""
    quota = F.broadcast(tier_table(accounts.sparkSession).withColumnRenamed("tier", "_tier"))
    out = accounts.join(quota, F.upper(F.col(tier)) == F.col("_tier"), "left")
    unknown = F.concat(F.lit("unknown plan tier: "), F.coalesce(F.col(tier), F.lit("")))
    return out.withColumn("error", F.when(F.col("_tier").isNull(), unknown)).drop("_tier")


def quota_usage(usage: DataFrame, quotas: DataFrame) -> DataFrame:
    """(namespace, resource, amount text) summed per namespace and compared with ``hard`` text.

    Equal texts are counted first, so each is parsed once. ``unread`` counts amounts that are no quantities and so
    not in the sum.
    """
    counted = usage.groupBy("namespace", "resource", "amount").agg(F.count(F.lit(1)).alias("_n"))
    amount = quantity(F.col("amount"))
    used = counted.groupBy("namespace", "resource").agg(
        F.sum(amount * F.col("_n")).alias("used"), F.sum(F.when(amount.isNull(), F.col("_n"))).alias("unread")
    )
    limits = quotas.select("namespace", "resource", quantity(F.col("hard")).alias("hard"))
    out = limits.join(used, ["namespace", "resource"], "left").withColumns(
        {"used": F.coalesce("used", F.lit(0.0)), "unread": F.coalesce("unread", F.lit(0))}
    )
    return out.withColumn("exceeded", F.col("used") > F.col("hard"))


def ratio(part: Column, whole: Column) -> Column:
    """Null on an empty or unknown whole."""
    return F.when(whole != 0, part / whole)
