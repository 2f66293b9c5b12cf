"""Request, job and span metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.quotas import ratio
from fleetlens.operators.segments import ROWS_PER_TASK, Scan, ranged, running, scan, split

BAD = lambda: F.when(~F.col("ok"), 1).otherwise(0)


def bucket(ts: str, seconds: int) -> Column:
    """Start of the tumbling window of an instant, counted from the epoch."""
    return F.window(ts, f"{seconds} seconds")["start"].alias("window_start")


def counters(events: DataFrame, kind: str) -> DataFrame:
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("total"))


def running_counters(events: DataFrame, kind: str, order: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    return running(events, [kind], order, {"total": Scan("row_number")}, rows_per_task)


def availability(requests: DataFrame, by: list[str]) -> DataFrame:
    good = F.sum(F.when(F.col("ok"), 1).otherwise(0))
    n = F.count(F.lit(1))
    return requests.groupBy(*by).agg(n.alias("total"), good.alias("successful"), ratio(good, n).alias("availability"))


def percentiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Exact interpolated percentiles per group.

    Rows are first counted per distinct value, and ranks come from a segmented running sum over
    those counts, so no task holds all values of a group.
    """
    s = split(df.select(*by, value).filter(F.col(value).isNotNull()), by, [value], rows_per_task)
    counts = s.df.groupBy(*s.group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = scan(s.with_df(counts), {"_upto": Scan("sum", F.col("_n"))}).done()
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    both = ranked.join(totals, by) if by else ranked.withColumn("_total", totals.scalar())
    aggs = []
    for name, p in probs.items():
        at = p * (F.col("_total") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value)))
        part = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * part).alias(name))
    return both.groupBy(*by).agg(*aggs)


def approx_percentiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Sketch variant: one partial aggregate, an actual element near each rank."""
    return df.groupBy(*by).agg(*[F.percentile_approx(value, p, accuracy).alias(n) for n, p in probs.items()])


def latency(requests: DataFrame, by: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    mean = requests.groupBy(*by).agg(F.avg("latency_ms").alias("mean_ms"))
    return mean.join(percentiles(requests, by, "latency_ms", {"p95_ms": 0.95, "p99_ms": 0.99}, rows_per_task), by)


def error_rate(requests: DataFrame, by: list[str], seconds: int) -> DataFrame:
    return requests.groupBy(*by, bucket("ts", seconds)).agg(
        F.count(F.lit(1)).alias("total"), F.sum(BAD()).alias("errors"), F.avg(BAD()).alias("error_rate")
    )


def throughput(requests: DataFrame, by: list[str], seconds: int) -> DataFrame:
    return requests.groupBy(*by, bucket("ts", seconds)).agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("per_second"))


def saturation(usage: DataFrame, capacity: DataFrame, key: str, load: str, limit: str) -> DataFrame:
    """Load summed per resource over its capacity; null on zero capacity."""
    used = usage.groupBy(key).agg(F.sum(load).alias("load"))
    out = capacity.join(used, key, "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
    return out.withColumn("saturation", ratio(F.col("load"), F.col(limit)))


def status_classes(requests: DataFrame, by: list[str]) -> DataFrame:
    klass = lambda n: F.sum(F.when(F.floor(F.col("code") / 100) == n, 1).otherwise(0)).alias(f"class_{n}xx")
    return requests.groupBy(*by).agg(klass(2), klass(3), klass(4), klass(5))


def queue_time(jobs: DataFrame, by: list[str]) -> DataFrame:
    wait = (F.unix_micros(F.col("started_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    return jobs.groupBy(*by).agg(F.avg(wait).alias("mean_wait_seconds"))


def active_users(events: DataFrame, user: str, period: Column) -> DataFrame:
    return events.groupBy(period.alias("period")).agg(F.count_distinct(user).alias("active_users"))


def approx_active_users(events: DataFrame, user: str, period: Column, rsd: float = 0.02) -> DataFrame:
    return events.groupBy(period.alias("period")).agg(F.approx_count_distinct(user, rsd).alias("active_users"))


def sessions(
    events: DataFrame, by: list[str], ts: str, tie: str, gap_seconds: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """A new session starts when the pause is longer than the gap."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    s = split(events.select(*by, ts, tie, us.alias("_us")), by, ["_us", tie], rows_per_task)
    s = scan(s, {"_prev": Scan("lag", F.col("_us"))})
    opens = F.when(F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > gap_seconds * 10**6), 1).otherwise(0)
    s = scan(s, {"session": Scan("sum", opens)})
    return s.done().groupBy(*by, "session").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events"),
        ((F.max("_us") - F.min("_us")) / 1e6).alias("seconds"),
    )


def churn(events: DataFrame, user: str, period: Column) -> DataFrame:
    """Per period number: active users, those absent in the next one, and their share. The last period has no next."""
    active = events.select(F.col(user).alias("u"), period.alias("period")).distinct()
    back = active.select("u", (F.col("period") - 1).alias("period"), F.lit(1).alias("stayed"))
    last = active.agg(F.max("period")).scalar()
    both = active.join(back, ["u", "period"], "left").filter(F.col("period") < last)
    gone = F.sum(F.when(F.col("stayed").isNull(), 1).otherwise(0))
    n = F.count(F.lit(1))
    return both.groupBy("period").agg(n.alias("active"), gone.alias("churned"), ratio(gone, n).alias("churn_rate"))


def slow_share(requests: DataFrame, by: list[str], limit_ms: float) -> DataFrame:
    return requests.groupBy(*by).agg(F.avg(F.when(F.col("latency_ms") > limit_ms, 1).otherwise(0)).alias("slow_share"))


def failed_calls(requests: DataFrame, by: list[str]) -> DataFrame:
    return requests.filter(~F.col("ok")).groupBy(*by).agg(F.count(F.lit(1)).alias("failed"))


def infra_rollup(samples: DataFrame, by: list[str]) -> DataFrame:
    """Operations per second, mean latency and health per instance."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = (F.max(us) - F.min(us)) / 1e6
    return samples.groupBy(*by).agg(
        ratio(F.count(F.lit(1)), span).alias("iops"), F.avg("latency_ms").alias("mean_ms"),
        F.avg(F.when(F.col("ok"), 1).otherwise(0)).alias("healthy_ratio"), F.bool_and("ok").alias("healthy"),
    )


def job_stats(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Success and failure rate over finished jobs, mean duration, pending count."""
    is_ = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    done = is_("COMPLETED") + is_("FAILED")
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("jobs"), ratio(is_("COMPLETED"), done).alias("success_rate"),
        ratio(is_("FAILED"), done).alias("failure_rate"), F.avg("duration_seconds").alias("mean_seconds"),
        is_("PENDING").alias("pending"),
    )


def worker_stats(messages: DataFrame, by: list[str], seconds: float, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    base = messages.groupBy(*by).agg(
        (F.count(F.lit(1)) / F.lit(float(seconds))).alias("per_second"), F.avg(BAD()).alias("error_rate"),
        F.count_distinct("tool").alias("tools"),
    )
    return base.join(latency(messages, by, rows_per_task), by)


def top(usage: DataFrame, by: str, cols: list[str], n: int | None = None) -> DataFrame:
    sums = usage.groupBy(by).agg(*[F.sum(c).alias(c) for c in cols]).orderBy(F.col(cols[0]).desc(), by)
    return sums.limit(n) if n else sums


def run_failed(steps: DataFrame, by: list[str]) -> DataFrame:
    return steps.groupBy(*by).agg(F.bool_or(F.col("exit_code") != 0).alias("failed"))


def rollup_health(checks: DataFrame, by: list[str]) -> DataFrame:
    """Degraded when any required dependency is bad; an optional one never degrades."""
    fine = F.bool_and(F.col("ok") | ~F.col("required"))
    return checks.groupBy(*by).agg(F.when(fine, "healthy").otherwise("degraded").alias("status"))


def load_profile(requests: DataFrame, seconds: float) -> DataFrame:
    n = F.count(F.lit(1))
    return requests.agg(
        n.alias("requests"), F.count_distinct("organization_id").alias("users"),
        ratio(n, F.count_distinct("organization_id")).alias("per_user"), (n / F.lit(float(seconds))).alias("per_second"),
    )


def posts_by_user(posts: DataFrame, by: str) -> DataFrame:
    return posts.groupBy(by).agg(F.count(F.lit(1)).alias("posts"))


def span_tree(spans: DataFrame) -> DataFrame:
    """Every span with its parent, null for a root."""
    parent = spans.select(
        F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.struct("span_id", "name", "start", "end").alias("parent")
    )
    on = (spans["trace_id"] == parent["_t"]) & (spans["parent_id"] == parent["_s"])
    return spans.join(parent, on, "left").drop("_t", "_s")


def trace_stats(spans: DataFrame) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"), F.sum(F.when(F.col("parent_id").isNotNull(), 1).otherwise(0)).alias("children"),
        ((F.max(us("end")) - F.min(us("start"))) / 1e6).alias("seconds"),
    )


def counter_rate(samples: DataFrame, by: list[str], range_seconds: int, step_seconds: int, tie: str | None = None) -> DataFrame:
    """Per-second rate of a counter over (t - range, t] at every step t, corrected for resets and extrapolated.

    Samples (ts, value) are first reduced to one row per cell, the longest time that both the range and the step are
    whole numbers of. Ranges of any length are then answered by running aggregates, linear in cells and ticks.
    """
    unit = math.gcd(range_seconds, step_seconds) * 10**6
    step, reach = step_seconds * 10**6, range_seconds * 10**6
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    order = ["_us", *([tie] if tie else [])]
    rows = samples.withColumn("_us", us).withColumn("_cell", F.ceil(F.col("_us") / F.lit(unit)).cast("long") * unit)
    inside = Window.partitionBy(*by, "_cell").orderBy(*order)  # at most one cell of one series
    drop = F.lag("value").over(inside)
    rows = rows.withColumn("_reset", F.when(drop > F.col("value"), drop).otherwise(0.0))
    at = F.struct(*order)
    cells = rows.groupBy(*by, "_cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("_us").alias("t0"), F.max("_us").alias("t1"),
        F.min_by("value", at).alias("v0"), F.max_by("value", at).alias("v1"), F.sum("_reset").alias("reset"),
    )
    chain = Window.partitionBy(*by).orderBy("_cell")  # one row per cell, whatever the data volume
    tick_from = lambda c: F.ceil(c / F.lit(step)).cast("long")
    cells = cells.withColumns({"_v": F.lag("v1").over(chain), "_next": F.lead("_cell").over(chain)}).withColumns({
        "_jump": F.when(F.col("_v") > F.col("v0"), F.col("_v")).otherwise(0.0),
        "_from": tick_from(F.col("_cell")),
        # the ticks up to the next cell's are this one's to name, as far as its range goes
        "_to": F.least(tick_from(F.col("_cell") + reach), tick_from(F.col("_next"))) - 1,
    })
    own = cells.select(
        *by, F.col("_cell").alias("_at"), F.lit(None).cast("long").alias("tick"), "n",
        F.struct("t0", "v0", "_jump").alias("first"), F.struct("t1", "v1").alias("last"),
        (F.col("reset") + F.col("_jump")).alias("reset"),
    )
    ticks = cells.filter("_from <= _to").select(*by, F.explode(F.sequence("_from", "_to")).alias("tick"))
    points = own.unionByName(ticks.withColumn("_at", F.col("tick") * step), allowMissingColumns=True)
    wanted = {"n": Scan("sum", F.col("n")), "first": Scan("min", F.col("first")), "last": Scan("max", F.col("last")), "reset": Scan("sum", F.col("reset"))}
    in_reach = reach // unit + reach // step + 2  # cells and ticks of a series
    found = ranged(points, by, F.col("_at"), 1 - reach, 0, {"_" + k: v for k, v in wanted.items()}, positions=in_reach)
    sums = found.filter(F.col("tick").isNotNull() & (F.col("_n") >= 2)).select(
        *by, "tick", F.col("_n").alias("n"), "_first.t0", "_last.t1", "_first.v0", "_last.v1",
        # a fall into the range's first cell happened before the range
        (F.col("_reset") - F.col("_first._jump")).alias("reset"),
    )
    end = F.col("tick") * step
    sampled = (F.col("t1") - F.col("t0")) / 1e6
    gap = sampled / (F.col("n") - 1)
    cut = lambda c: F.when(c >= gap * 1.1, gap / 2).otherwise(c)
    inc = F.col("v1") - F.col("v0") + F.col("reset")
    to_start = cut((F.col("t0") - (end - range_seconds * 10**6)) / 1e6)
    zero = F.when((inc > 0) & (F.col("v0") >= 0), F.least(to_start, sampled * F.col("v0") / inc)).otherwise(to_start)
    to_end = cut((end - F.col("t1")) / 1e6)
    rate = inc * (sampled + zero + to_end) / sampled / range_seconds
    return sums.filter(sampled > 0).select(*by, F.timestamp_micros(end).cast("timestamp_ntz").alias("tick"), rate.alias("rate"))
