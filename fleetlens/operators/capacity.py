"""Lag, replica recommendations, concurrency, throttle state, ids and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.segments import ROWS_PER_TASK, Scan, ranged, running, scan, split
from fleetlens.session import written

# fixed values: public autoscaler tolerance, and the default specification
TOLERANCE = 0.1
DEFAULT_SPEC = {
    "min": 2, "max": 10, "targets": {"cpu": 70.0, "memory": 80.0}, "stabilise_seconds": 300,
    "down_percent": 50, "up_percent": 100, "up_pods": 2,
}


def consumer_lag(ends: DataFrame, committed: DataFrame, threshold: int) -> DataFrame:
    """End offset less committed offset, summed per group. Both sides have (group, partition, offset)."""
    last = lambda df, name: df.groupBy("group", "partition").agg(F.max("offset").alias(name))
    both = last(ends, "_end").join(last(committed, "_done"), ["group", "partition"], "left")
    lag = F.greatest(F.col("_end") - F.coalesce("_done", F.lit(0)), F.lit(0))
    return both.groupBy("group").agg(F.sum(lag).alias("lag")).withColumn("over", F.col("lag") > threshold)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def replica_recommendation(metrics: DataFrame, by: list[str], ts: str, spec: dict = DEFAULT_SPEC) -> DataFrame:
    """Recommended replicas per observation (columns current_replicas and one per target metric).

    Per metric ceil(current * value / target) unless within tolerance, the maximum over metrics,
    the maximum over the stabilisation window, then the step limits and the bounds.
    """
    current = F.col("current_replicas")
    wanted = []
    for name, target in spec["targets"].items():
        use = F.col(name) / F.lit(target)
        wanted.append(F.when(F.abs(use - 1) <= TOLERANCE, current).otherwise(F.ceil(current * use)).cast("long"))
    desired = clamp(F.greatest(*wanted) if len(wanted) > 1 else wanted[0], spec["min"], spec["max"])
    rows = metrics.withColumn("desired", desired.cast("long"))
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    rows = ranged(rows, by, at, -spec["stabilise_seconds"], 0, {"stabilised": Scan("max", F.col("desired"))})
    calm = F.when(F.col("desired") < current, F.least(F.col("stabilised"), current)).otherwise(F.col("desired"))
    ceiling = F.greatest(F.ceil(current * (1 + spec["up_percent"] / 100)), current + spec["up_pods"])
    floor = F.floor(current * (1 - spec["down_percent"] / 100))
    limited = F.least(F.greatest(calm, floor), ceiling)
    return rows.withColumn("recommended", clamp(limited, spec["min"], spec["max"]).cast("long"))


def queue_replicas(lag: DataFrame, per_replica: int, low: int, high: int, cpu_target: float | None = None) -> DataFrame:
    """ceil(lag / threshold) within bounds; with a CPU trigger the larger of both. Columns lag, cpu, current_replicas."""
    wanted = F.ceil(F.col("lag") / F.lit(per_replica))
    if cpu_target is not None:
        wanted = F.greatest(wanted, F.ceil(F.col("current_replicas") * F.col("cpu") / F.lit(cpu_target)))
    return lag.withColumn("replicas", clamp(wanted, low, high).cast("long"))


def assign_ids(df: DataFrame, order: list[str], start: int = 1, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Dense ids in order. A large table is cut into ranges that are numbered in parallel."""
    out = running(df, [], order, {"id": Scan("row_number")}, rows_per_task)
    return out.withColumn("id", F.col("id") + (start - 1))


def positions(df: DataFrame, by: list[str], order: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    s = split(df, by, order, rows_per_task)
    s = scan(s, {"position": Scan("row_number")})
    s = scan(s, {"_next": Scan("lag", F.lit(True))}, reverse=True)
    return s.done().withColumns({"is_first": F.col("position") == 1, "is_last": F.col("_next").isNull()}).drop("_next")


def concurrency(jobs: DataFrame, by: list[str], start: str, end: str, limit: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Running jobs after each instant at which one starts or ends; an end frees its place at that instant.

    Jobs are reduced to one row per instant, written once, and a key of very many instants is cut by their number."""
    begun = F.struct(F.col(start).alias("instant"), F.lit(1).alias("d"))
    done = F.struct(F.col(end).alias("instant"), F.lit(-1).alias("d"))
    changes = jobs.select(*by, F.explode(F.array(begun, done)).alias("c")).filter("c.instant is not null")
    steps = changes.groupBy(*by, "c.instant").agg(F.sum("c.d").alias("_d"))
    sums = running(written(steps, "steps"), by, ["instant"], {"running": Scan("sum", F.col("_d"))}, rows_per_task)
    return sums.drop("_d").withColumn("over_limit", F.col("running") > limit)


def throttle_state(
    admitted: DataFrame, by: list[str], as_of: Column, short: int, long: int, limit_short: int, limit_long: int
) -> DataFrame:
    """Used cost, limits and reset instants of both windows (in seconds) at one instant."""
    now = F.unix_micros(as_of.cast("timestamp"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    recent = admitted.filter((us > now - long * 10**6) & (us <= now))
    near = us > now - short * 10**6
    used = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = recent.groupBy(*by).agg(
        used(F.when(near, F.col("cost"))).alias("used_short"), used(F.col("cost")).alias("used_long"),
        F.timestamp_micros(F.min(F.when(near, us)) + short * 10**6).cast("timestamp_ntz").alias("reset_short"),
        F.timestamp_micros(F.min(us) + long * 10**6).cast("timestamp_ntz").alias("reset_long"),
    )
    return out.withColumns(
        {
            "limit_short": F.lit(limit_short).cast("long"), "limit_long": F.lit(limit_long).cast("long"),
            "is_throttled": (F.col("used_short") >= limit_short) | (F.col("used_long") >= limit_long),
        }
    )
