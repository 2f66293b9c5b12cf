"""Runs of states: islands, incidents, alert and probe states, objectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.metrics import BAD, bucket
from fleetlens.operators.quotas import ratio
from fleetlens.operators.segments import ROWS_PER_TASK, Scan, scan, split


def islands(
    df: DataFrame, by: list[str], order: list[str], flag: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Number of the run of equal flags each row belongs to, from 1 per key."""
    s = scan(split(df, by, order, rows_per_task), {"_prev": Scan("lag", F.col(flag))})
    opens = F.when(F.col("_prev").eqNullSafe(F.col(flag)), 0).otherwise(1)
    return scan(s, {"island": Scan("sum", opens)}).done().drop("_prev")


def incidents(
    df: DataFrame, by: list[str], order: list[str], ts: str = "ts", ok: str = "ok", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Runs of failures: start, and the first good instant after them (null while open)."""
    s = scan(split(df, by, order, rows_per_task), {"_prev": Scan("lag", F.col(ok))})
    turns = s.df.filter(~F.col("_prev").eqNullSafe(F.col(ok))).drop("_prev")
    ends = scan(s.with_df(turns), {"recovered": Scan("lag", F.col(ts))}, reverse=True).done()
    return ends.filter(~F.col(ok)).drop(ok).withColumnRenamed(ts, "started")


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def incident_count(found: DataFrame, period: Column) -> DataFrame:
    return found.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("incidents"))


def mttr(found: DataFrame, by: list[str]) -> DataFrame:
    """Mean seconds to recovery; open incidents are left out."""
    closed = found.filter("recovered is not null")
    return closed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("closed"), F.avg(_seconds(F.col("started"), F.col("recovered"))).alias("mttr_seconds")
    )


def mtbf(found: DataFrame, by: list[str]) -> DataFrame:
    """Mean seconds between incident starts; the gaps add up to last start minus first start."""
    us = F.unix_micros(F.col("started").cast("timestamp"))
    n = F.count(F.lit(1))
    return found.groupBy(*by).agg(
        n.alias("incidents"), F.when(n > 1, (F.max(us) - F.min(us)) / 1e6 / (n - 1)).alias("mtbf_seconds")
    )


TICKS_AT_ONCE = 4096  # of one interval that one row is expanded to


def _interval(first: Column, last: Column, state: Column, since: Column) -> Column:
    return F.struct(first.alias("from_tick"), last.alias("to_tick"), state.alias("state"), since.alias("since"))


def alert_intervals(
    ticks: DataFrame, by: list[str], step: int, for_: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """from_tick, to_tick, state and ``since`` of every stretch of one state: inactive, pending, or firing once the
    condition has held for ``for_`` (in tick units). A silent year is one row.

    ``ticks`` has by + (tick, active), one row per tick, whole steps apart; a tick without a row is false, and a series
    lives from its first tick to its last. Only true ticks are put in order, and a series of very many is cut."""
    none = F.lit(None).cast("long")
    true = ticks.filter("active").select(*by, F.col("tick").cast("long").alias("tick"))
    s = scan(split(true, by, ["tick"], rows_per_task), {"_prev": Scan("lag", F.col("tick"))})
    opens = F.col("_prev").isNull() | (F.col("tick") - F.col("_prev") > step)
    s = scan(s, {"_run": Scan("sum", F.when(opens, 1).otherwise(0))})
    runs = s.done().groupBy(*by, "_run").agg(
        F.min("tick").alias("_a"), F.max("tick").alias("_b"), F.min(F.when(opens, F.col("_prev"))).alias("_before")
    )
    a, b, fires = F.col("_a"), F.col("_b"), F.col("_a") + -(-for_ // step) * step
    inside = F.array(
        F.when(F.col("_before").isNotNull(), _interval(F.col("_before") + step, a - step, F.lit("inactive"), none)),
        F.when(fires > a, _interval(a, F.least(b, fires - step), F.lit("pending"), a)),
        F.when(fires <= b, _interval(fires, b, F.lit("firing"), a)),
    )
    when = F.when(F.col("active"), F.col("tick"))
    life = ticks.groupBy(*by).agg(
        F.min("tick").cast("long").alias("_a"), F.max("tick").cast("long").alias("_b"), F.min(when).alias("_on"), F.max(when).alias("_off")
    )
    quiet = lambda first, last: F.when(first <= last, _interval(first, last, F.lit("inactive"), none))
    outside = F.array(quiet(a, F.coalesce(F.col("_on") - step, b)), quiet(F.col("_off") + step, b))
    parts = [df.select(*by, F.explode(F.array_compact(p)).alias("i")) for df, p in ((runs, inside), (life, outside))]
    return parts[0].unionAll(parts[1]).select(*by, "i.*")


def interval_ticks(intervals: DataFrame, by: list[str], step: int) -> DataFrame:
    """Every tick of the intervals with its state, for callers that need rows: long intervals in bounded pieces."""
    size = step * TICKS_AT_ONCE
    piece = F.explode(F.sequence("from_tick", "to_tick", F.lit(size).cast("long"))).alias("_at")
    pieces = intervals.select(*by, "from_tick", "to_tick", "state", "since", piece)
    until = F.least(F.col("to_tick"), F.col("_at") + (size - step))
    return pieces.select(*by, F.explode(F.sequence("_at", until, F.lit(step).cast("long"))).alias("tick"), "from_tick", "state", "since")


def alert_states(
    ticks: DataFrame, by: list[str], step: int, for_: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The state of every whole tick from a series' first to its last: ``alert_intervals``, tick by tick.

    A series has as many rows as its life has ticks, whatever the number of events behind them."""
    rows = interval_ticks(alert_intervals(ticks, by, step, for_, rows_per_task), by, step)
    entered = (F.col("state") == "firing") & (F.col("tick") == F.col("from_tick"))
    return rows.select(
        *by, "tick", (F.col("state") != "inactive").alias("active"), "since", "state", entered.alias("entered_firing")
    )


def alert_count(states: DataFrame, by: list[str]) -> DataFrame:
    """Times that an alert began to fire, from its states or its intervals."""
    begins = F.col("entered_firing") if "entered_firing" in states.columns else F.col("state") == "firing"
    return states.groupBy(*by).agg(F.sum(F.when(begins, 1).otherwise(0)).alias("alerts"))


def probe_state(
    probes: DataFrame, by: list[str], order: list[str], healthy_n: int, unhealthy_n: int, initial: str = "unknown",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """State after each probe: n equal results in a row flip it."""
    s = split(probes, by, order, rows_per_task)
    s = scan(s, {"_rn": Scan("row_number"), "_prev": Scan("lag", F.col("ok"))})
    turn = F.when(~F.col("_prev").eqNullSafe(F.col("ok")), F.col("_rn"))
    s = scan(s, {"_turn": Scan("last", turn)})
    run = F.col("_rn") - F.col("_turn") + 1
    flip = F.when(F.col("ok") & (run == healthy_n), "healthy").when(~F.col("ok") & (run == unhealthy_n), "unhealthy")
    s = scan(s, {"state": Scan("last", flip)})
    out = s.done().withColumn("run_length", run).withColumn("state", F.coalesce("state", F.lit(initial)))
    return out.drop("_rn", "_prev", "_turn")


def error_budget(requests: DataFrame, target: float, days: int, by: list[str] = ()) -> DataFrame:
    """Share of the allowed failures used per period of ``days``."""
    total, bad = F.count(F.lit(1)), F.sum(BAD())
    used = ratio(bad, total * (1 - target))
    return requests.groupBy(*by, bucket("ts", days * 86400)).agg(
        total.alias("total"), bad.alias("bad"), used.alias("budget_used"), (1 - used).alias("budget_left"), (used > 1).alias("violated")
    )


def sla(requests: DataFrame, slo: float, margin: float, days: int, by: list[str] = ()) -> DataFrame:
    """Breach of the agreement, whose target is the objective less a margin."""
    out = error_budget(requests, slo - margin, days, by)
    return out.select(*by, "window_start", "total", "bad", F.col("violated").alias("breached"))


def dr_compliance(
    found: DataFrame, primary: DataFrame, replicas: DataFrame, by: list[str], rto_seconds: float, rpo_seconds: float
) -> DataFrame:
    """Longest downtime against the recovery time, replica lag against the recovery point objective."""
    down = found.filter("recovered is not null").groupBy(*by).agg(
        F.max(_seconds(F.col("started"), F.col("recovered"))).alias("worst_downtime")
    )
    head = primary.groupBy(*by).agg(F.max("ts").alias("_p"))
    copy = replicas.groupBy(*by).agg(F.max("ts").alias("_r"))
    lag = head.join(copy, by, "left").select(*by, _seconds(F.col("_r"), F.col("_p")).alias("data_loss"))
    out = lag.join(down, by, "left").withColumn("worst_downtime", F.coalesce("worst_downtime", F.lit(0.0)))
    return out.withColumn("rto_met", F.col("worst_downtime") <= rto_seconds).withColumn(
        "rpo_met", F.coalesce(F.col("data_loss") <= rpo_seconds, F.lit(False))
    )
