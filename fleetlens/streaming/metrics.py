"""Windowed counters, alert evaluation and routing on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from fleetlens.operators.rows import route
from fleetlens.operators.slo import interval_ticks
from fleetlens.streaming.runs import use_rocksdb


def counter_stream(events: DataFrame, kind: str, window: str, delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events per kind and window; a window is final once the watermark has passed it."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = events.withWatermark("ts", delay).groupBy(w, kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), kind, "n")


def session_stream(events: DataFrame, user: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    found = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), user).agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended")
    )
    return found.select(user, "started", "ended", "events")


class AlertProcessor(StatefulProcessor):
    """Per series: last tick and start of the current true run. Absent ticks are false, and a stretch of them is one row."""

    def __init__(self, kind: str, step: int, for_: int):
        self.kind, self.step, self.for_ = kind, step, for_

    def init(self, handle) -> None:
        self.state = handle.getValueState("run", "tick bigint, since bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("tick")
        tick, active = batch["tick"].to_numpy(), batch["active"].to_numpy(dtype=bool)
        last, since = self.state.get() if self.state.exists() else (None, None)
        before = np.append(tick[0] - self.step if last is None else last, tick[:-1])
        gap = tick - before > self.step
        # a run starts at the latest true tick that follows no true one, or at the one held from the last batch
        was = np.append(since is not None, active[:-1]) & ~gap
        starts = np.where(active & ~was, tick, np.int64(-1 if since is None else since))
        begun = np.maximum.accumulate(starts)
        state = np.where(~active, "inactive", np.where(tick - begun >= self.for_, "firing", "pending"))
        self.state.update((int(tick[-1]), int(begun[-1]) if active[-1] else None))
        silent = pd.DataFrame({"from_tick": before[gap] + self.step, "to_tick": tick[gap] - self.step, "state": "inactive"})
        told = pd.concat([silent, pd.DataFrame({"from_tick": tick, "to_tick": tick, "state": state})])
        told.insert(0, self.kind, [key[0]] * len(told))
        yield told

    def close(self) -> None:
        pass


def alert_interval_stream(
    events: DataFrame, kind: str, step: int, for_: int, condition: Column, delay: str = "10 minutes"
) -> DataFrame:
    """Evaluate a condition over the count ``n`` of each closed window of ``step`` seconds: kind, from_tick, to_tick, state.

    A window with events is a row, and so is a stretch of any length without."""
    use_rocksdb(events.sparkSession)
    counts = counter_stream(events, kind, f"{step} seconds", delay)
    ticks = counts.select(kind, F.unix_timestamp("window_start").alias("tick"), condition.alias("active"))
    added = [T.StructField(c, T.LongType()) for c in ("from_tick", "to_tick")] + [T.StructField("state", T.StringType())]
    schema = T.StructType([ticks.schema[kind], *added])
    return ticks.groupBy(kind).transformWithStateInPandas(AlertProcessor(kind, step, for_), schema, "append", "None")


def alert_stream(
    events: DataFrame, kind: str, step: int, for_: int, condition: Column, delay: str = "10 minutes"
) -> DataFrame:
    """``alert_interval_stream``, tick by tick."""
    told = alert_interval_stream(events, kind, step, for_, condition, delay)
    return interval_ticks(told.withColumn("since", F.lit(None).cast("long")), [kind], step).select(kind, "tick", "state")


def route_stream(events: DataFrame, routes: list[dict], sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Each micro-batch's rows go to the sink of their first matching route, with the batch's number."""
    routed = route(events, routes).filter("target is not null")

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for target, sink in sinks.items():
                sink(batch.filter(F.col("target") == target), epoch)
        finally:
            batch.unpersist()

    return routed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
