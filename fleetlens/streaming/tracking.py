"""Streams of run tracking: changes, correlation, job life cycle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fleetlens.operators.tracking import MESSAGE_TIMEOUT, change_line, level_of, run_phase
from fleetlens.streaming.runs import use_rocksdb

CHANGES = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("poll", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("conclusion", T.StringType()),
        T.StructField("is_new", T.BooleanType()),
    ]
)


LISTING = ["poll", "listing_pos", "job_id", "name", "status", "conclusion", "run_status", "run_conclusion"]


def _values(column: pd.Series) -> list:
    """The column's values, with None for what is missing."""
    return [None if v is None or v != v else v for v in column.tolist()]


class ChangeProcessor(StatefulProcessor):
    """Per run: each job's state in the last poll; silent after the run has ended, when only that is remembered.

    A job missing from a poll is forgotten: when it comes back, it has started again.
    """

    def init(self, handle) -> None:
        self.jobs = handle.getMapState("jobs", "job_id bigint", "status string, conclusion string")
        self.ended = handle.getValueState("ended", "poll bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            return
        # plain values: most runs have few rows in a batch, for which a frame's operations cost more than the work
        listings = [r for part in rows for r in zip(*(_values(part[c]) for c in LISTING)) if r[0] is not None]
        listings.sort(key=lambda r: (r[0], r[1] is None, 0 if r[1] is None else r[1]))
        seen = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
        before, out = dict(seen), []
        for poll, group in groupby(listings, key=lambda r: r[0]):
            listed, group = {}, list(group)
            for _, _, job, name, job_status, job_conclusion, _, _ in group:
                now = (job_status, job_conclusion)
                if seen.get(job) != now:
                    out.append((key[0], poll, "log", name, job_status, job_conclusion, job not in seen))
                listed[job] = now
            seen = listed
            status, conclusion = group[0][-2:]
            out.append((key[0], poll, "status", None, status, conclusion, None))
            if status == "completed":
                out.append((key[0], poll, "complete", None, status, conclusion, None))
                self.ended.update((int(poll),))
                seen = {}
                break
        for job in before.keys() - seen.keys():
            self.jobs.removeKey((job,))
        for job, state in seen.items():
            if before.get(job) != state:
                self.jobs.updateValue((job,), state)
        yield pd.DataFrame(out, columns=CHANGES.fieldNames())

    def close(self) -> None:
        pass


def change_stream(snapshots: DataFrame) -> DataFrame:
    """log, status and complete messages of polled runs.

    ``snapshots`` has run_id, poll, run_status, run_conclusion, listing_pos, job_id, name, status, conclusion.
    """
    use_rocksdb(snapshots.sparkSession)
    rows = snapshots.groupBy("run_id").transformWithStateInPandas(ChangeProcessor(), CHANGES, "append", "None")
    line = change_line(F.col("name"), F.col("status"), F.col("conclusion"), F.col("is_new"))
    return rows.select(
        "run_id", "poll", "kind",
        F.when(F.col("kind") == "log", line).alias("line"),
        F.when(F.col("kind") == "log", level_of(line)).alias("level"),
        F.when(F.col("kind") != "log", run_phase(F.col("status"), F.col("conclusion"))).alias("phase"),
    )


def correlate_stream(
    dispatch: DataFrame, runs: DataFrame, by: str, early: int = 30, late: int = 90, delay: str = "10 minutes"
) -> DataFrame:
    """First listed run per dispatch within the time bounds; none within ``late`` seconds means failed.

    The join keeps only rows the watermark may still match, and the aggregate picks one run per dispatch.
    """
    # both sides also meet in a time bucket, so a hot key is spread over many join tasks
    width = (early + late) * 10**6
    bucket = lambda us: F.floor(us / F.lit(width)).cast("long")
    d = dispatch.select(F.col(by).alias("d_key"), "dispatch_id", F.col("ts").alias("d_ts")).withWatermark("d_ts", delay)
    d = d.withColumn("d_bucket", bucket(F.unix_micros("d_ts")))
    r = runs.select(F.col(by).alias("r_key"), "run_id", "listing_pos", F.col("ts").alias("r_ts")).withWatermark("r_ts", delay)
    us = F.unix_micros("r_ts")
    r = r.withColumn("r_bucket", F.explode(F.sequence(bucket(us - late * 10**6), bucket(us + early * 10**6))))
    near = (
        (F.col("d_key") == F.col("r_key"))
        & (F.col("d_bucket") == F.col("r_bucket"))
        & F.expr(f"r_ts >= d_ts - INTERVAL {early} SECONDS")
        & F.expr(f"r_ts <= d_ts + INTERVAL {late} SECONDS")
    )
    found = d.join(r, near, "left_outer").groupBy("d_key", "dispatch_id", "d_ts").agg(
        F.min_by("run_id", "listing_pos").alias("run_id")
    )
    phase = F.when(F.col("run_id").isNull(), "failed").otherwise("syncing")
    message = F.when(F.col("run_id").isNull(), MESSAGE_TIMEOUT)
    return found.select(F.col("d_key").alias(by), "dispatch_id", F.col("d_ts").alias("ts"), "run_id", phase.alias("phase"), message.alias("message"))


JOB_STATES = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("at_ms", T.LongType()),
    ]
)
# fixed values: states that end a job, and the order of the others
TERMINAL = {"COMPLETED", "FAILED", "CANCELLED", "TIMEOUT"}
RANK = {"UNSPECIFIED": -1, "PENDING": 0, "RUNNING": 1}
KEEP_MS = 24 * 3600 * 1000  # an ended job is remembered for a day after its deadline, against late events


class JobProcessor(StatefulProcessor):
    """Folds status events; an event-time timer ends a job that outlives its timeout."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, deadline bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_ms", "status"], kind="stable")
        status, deadline = self.state.get() if self.state.exists() else (None, None)
        out = []
        for r in batch.itertuples():
            if deadline is None:
                deadline = int(r.at_ms) + int(r.timeout_seconds) * 1000
                self.handle.registerTimer(deadline)
            if status in TERMINAL:
                break
            if r.at_ms > deadline:
                status = "TIMEOUT"
                out.append((key[0], status, deadline))
            elif r.status in TERMINAL or status is None or RANK.get(r.status, -1) > RANK.get(status, -1):
                status = r.status
                out.append((key[0], status, int(r.at_ms)))
        self.state.update((status, deadline))
        yield pd.DataFrame(out, columns=JOB_STATES.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, deadline = self.state.get()
        if expiredTimerInfo.getExpiryTimeInMs() > deadline:
            self.state.clear()
            return
        self.handle.registerTimer(deadline + KEEP_MS)
        if status not in TERMINAL:
            self.state.update(("TIMEOUT", deadline))
            yield pd.DataFrame([(key[0], "TIMEOUT", deadline)], columns=JOB_STATES.fieldNames())

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Status changes from (job_id, ts, status, timeout_seconds) events."""
    use_rocksdb(events.sparkSession)
    rows = events.withWatermark("ts", delay).withColumn("at_ms", F.unix_millis("ts"))
    out = rows.groupBy("job_id").transformWithStateInPandas(JobProcessor(), JOB_STATES, "append", "EventTime")
    return out.select("job_id", "status", F.timestamp_millis("at_ms").alias("ts"))


def tail_stream(lines: DataFrame, *cols: str) -> DataFrame:
    """New log lines as they arrive."""
    return lines.select(*cols)
