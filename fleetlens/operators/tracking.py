"""Run tracking: phases, messages, snapshot diffs, correlation, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.segments import ROWS_PER_TASK, Scan, ranged, running

# fixed values: run states and the texts shown for them
WAITING = ["queued", "waiting", "requested", "pending"]
MESSAGE_WAITING = "Workflow run queued on GitHub Actions"
MESSAGE_RUNNING = "Workflow run in progress"
MESSAGE_DONE = {
    "success": "GitHub Actions workflow completed successfully",
    "failure": "GitHub Actions workflow failed",
    "cancelled": "GitHub Actions workflow was cancelled",
}
MESSAGE_OTHER = "Polling GitHub Actions"
MESSAGE_TIMEOUT = "Timed out waiting for GitHub Actions run"


def run_phase(status: Column, conclusion: Column) -> Column:
    return (
        F.when(status.isNull() | status.isin(*WAITING), "provisioning")
        .when(status == "in_progress", "syncing")
        .when((status == "completed") & conclusion.eqNullSafe("success"), "ready")
        .when(status == "completed", "failed")
        .otherwise("syncing")
    )


def run_message(status: Column, conclusion: Column) -> Column:
    done = F.coalesce(
        *[F.when(conclusion == c, F.lit(m)) for c, m in MESSAGE_DONE.items()],
        F.concat(
            F.lit("GitHub Actions workflow completed ("),
            F.coalesce(F.nullif(conclusion, F.lit("")), F.lit("unknown")),
            F.lit(")"),
        ),
    )
    return (
        F.when(status.isin(*WAITING), MESSAGE_WAITING)
        .when(status == "in_progress", MESSAGE_RUNNING)
        .when(status == "completed", done)
        .otherwise(MESSAGE_OTHER)
    )


def level_of(line: Column) -> Column:
    return F.when(F.lower(line).contains("fail"), "error").otherwise("info")


def change_line(name: Column, status: Column, conclusion: Column, is_new: Column) -> Column:
    shown = F.when(status == "completed", F.coalesce(F.nullif(conclusion, F.lit("")), status)).otherwise(status)
    name = F.coalesce(F.nullif(name, F.lit("")), F.lit("job"))
    text = lambda c: F.coalesce(c, F.lit("None"))
    # fixed values: the lines' wording
    return F.when(is_new, F.concat(F.lit("Job started: "), name, F.lit(" ("), text(status), F.lit(")"))).otherwise(
        F.concat(F.lit("Job "), name, F.lit(": "), text(shown))
    )


def diff_snapshots(prev: DataFrame, curr: DataFrame, key: list[str]) -> DataFrame:
    """Change lines between two polls (columns name, status, conclusion). Vanished jobs say nothing."""
    old = prev.select(*key, F.struct("status", "conclusion").alias("_old"))
    both = curr.join(old, key, "left")
    is_new = F.col("_old").isNull()
    same = F.col("status").eqNullSafe(F.col("_old.status")) & F.col("conclusion").eqNullSafe(F.col("_old.conclusion"))
    changed = both.filter(is_new | ~same)
    line = change_line(F.col("name"), F.col("status"), F.col("conclusion"), is_new)
    return changed.withColumn("line", line).withColumn("level", level_of(F.col("line"))).drop("_old")


def change_events(
    polls: DataFrame, key: list[str], order: list[str], rows_per_task: int = ROWS_PER_TASK,
    run: list[str] | None = None,
) -> DataFrame:
    """The same lines over a whole history of polls, each job compared with the poll before.

    ``run`` names the key columns of what is polled as a whole (default: the whole key). A job that was missing from
    the run's previous poll is new again.
    """
    run = run or key
    state = F.struct(F.struct(*order).alias("at"), "status", "conclusion")
    rows = running(polls, key, order, {"_old": Scan("lag", state)}, rows_per_task)
    if run != key:
        listed = polls.select(*run, *order).distinct()
        before = running(listed, run, order, {"_before": Scan("lag", F.struct(*order))}, rows_per_task)
        rows = rows.join(before, [*run, *order])
        rows = rows.withColumn("_old", F.when(F.col("_old.at") == F.col("_before"), F.col("_old"))).drop("_before")
    is_new = F.col("_old").isNull()
    same = F.col("status").eqNullSafe(F.col("_old.status")) & F.col("conclusion").eqNullSafe(F.col("_old.conclusion"))
    line = change_line(F.col("name"), F.col("status"), F.col("conclusion"), is_new)
    return (
        rows.filter(is_new | ~same).withColumn("line", line).withColumn("level", level_of(F.col("line"))).drop("_old")
    )


def run_created(
    polls: DataFrame, key: list[str], order: list[str], run_id: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """A line whenever a poll names another run than the one known before; polls without a run say nothing."""
    named = polls.filter(F.col(run_id).isNotNull() & (F.col(run_id) != 0))
    rows = running(named, key, order, {"_old": Scan("lag", F.col(run_id))}, rows_per_task)
    # fixed value: the line's wording
    line = F.concat(F.lit("GitHub Actions run #"), F.col(run_id), F.lit(" created"))
    fresh = rows.filter(~F.col("_old").eqNullSafe(F.col(run_id))).drop("_old")
    return fresh.withColumn("line", line).withColumn("level", level_of(F.col("line")))


def suffix_keys(runs: DataFrame, path: str, dispatch: DataFrame, tail: str) -> DataFrame:
    """``runs`` once for each value of the dispatches' ``tail`` that their path ends in, as column ``tail``.

    Paths are cut into all their ends, at most one for each sign, so the match is an equi-join."""
    ends = F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.col(path).substr(i, F.length(path)))
    wanted = dispatch.select(tail).distinct()
    return runs.filter(F.length(path) > 0).withColumn(tail, F.explode(ends)).join(wanted, tail, "left_semi")


def correlate(
    dispatch: DataFrame, runs: DataFrame, by: list[str], early: int = 30, late: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """First listed run of the same ``by`` created no earlier than ``early`` seconds before the dispatch.

    ``dispatch`` has by + (dispatch_id, ts); ``runs`` has by + (run_id, listing_pos, ts). With ``late``
    a run must also appear within that many seconds after the dispatch. No pairs are formed: both
    sides go into one ordered sequence and the least listing position ahead is carried along.
    """
    us = lambda: F.unix_micros(F.col("ts").cast("timestamp"))
    d = dispatch.select(
        *by, "dispatch_id", "ts", us().alias("_us"), F.lit(None).cast("struct<pos: bigint, run_id: bigint>").alias("_run")
    )
    r = runs.select(
        *by, F.lit(None).cast("long").alias("dispatch_id"), "ts", us().alias("_us"),
        F.struct(F.col("listing_pos").cast("long").alias("pos"), F.col("run_id").cast("long").alias("run_id")).alias("_run"),
    )
    if late is not None:
        rows = ranged(d.unionByName(r), by, F.col("_us"), -early * 10**6, late * 10**6, {"_best": Scan("min", F.col("_run"))}, rows_per_task)
    else:
        # a run at exactly dispatch - early counts: at equal positions runs come after the dispatch
        shifted = d.withColumn("_us", F.col("_us") - early * 10**6).unionByName(r)
        shifted = shifted.withColumn("_side", F.when(F.col("_run").isNull(), 0).otherwise(1))
        rows = running(shifted, by, ["_us", "_side"], {"_best": Scan("min", F.col("_run"))}, rows_per_task, reverse=True)
    return rows.filter("_run is null").select(*by, "dispatch_id", "ts", F.col("_best.run_id").alias("run_id"))


LIMITED_ROWS = 1000  # up to which Spark limits a window's rows before the shuffle (its default)


def last_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Newest n rows per key. Spark keeps only n per key and task before the shuffle, as long as these are few; for many,
    positions come from a segmented scan."""
    if n > LIMITED_ROWS:
        return running(df, by, order, {"_rn": Scan("row_number")}, reverse=True).filter(F.col("_rn") <= n).drop("_rn")
    newest = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def tail(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Last n lines per key, oldest first."""
    return last_n(df, by, order, n).orderBy(*by, *order)


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")
