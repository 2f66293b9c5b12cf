"""Streaming intake: the batch machine with its state in the state store.

Requests wait, within the watermark's delay, until none can come before them. A few wait beside the tenant's state, which
is then read and written once a trigger. More wait in pieces of bounded size under keys of a map, so that a trigger reads
the pieces that hold due requests and no others. A tenant has one timer, at its next due request or expiry. State per tenant is bounded by the limits (admitted instants of the long window, live locks)
and by what waits. A silent tenant's short window is forgotten first and all of its state after the long window. These
expiries follow event time, for which Spark's own time-to-live, which follows the clock, cannot be set.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from fleetlens.operators.intake import IntakeMachine, SlidingThrottle, TtlLocks, prepare
from fleetlens.streaming.runs import folder_stream, use_rocksdb

# fixed values: an idle tenant's windows are forgotten ten seconds and ten minutes after their length
SHORT_BUFFER_US = 10 * 10**6
IDLE_BUFFER_US = 600 * 10**6

OUTPUT = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("organization_id", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("lock_key", T.StringType()),
        T.StructField("envelope", T.StringType()),
        T.StructField("us", T.LongType()),
    ]
)


WAITING = ["us", "request_id", "error", "lock_key", "envelope", "release_us"]
PIECE = 256  # requests that wait under one key, or beside the state


class IntakeProcessor(StatefulProcessor):
    """Decides a tenant's requests in the order of their instants, whatever order they arrive in within the delay.

    A row with ``release_us`` is no request: it gives back the lock that the request of that instant took, if it still
    holds it, before any request of its own instant."""

    def __init__(self, throttle: SlidingThrottle, locks: TtlLocks):
        self.machine = IntakeMachine(throttle, locks)
        self.short_us = throttle.short + SHORT_BUFFER_US
        self.keep_us = max(throttle.long, locks.ttl) + IDLE_BUFFER_US

    def init(self, handle) -> None:
        self.handle = handle
        # the machine's state (null before the first decision) and last instant, the few requests that wait here, first
        # instant and key of every waiting piece, and the timer that is set: one value, as every access is a round trip
        self.state = handle.getValueState("intake", "saved string, last bigint, few string, pieces string, timer bigint")
        self.waiting = handle.getMapState("waiting", "piece bigint", "requests string")

    def _keep(self, saved: str | None, last: int | None, few: list, pieces: list, timer: int | None, at: int | None) -> None:
        """Keep the state, with the timer moved to ``at`` (null: none)."""
        if timer != at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        if saved is not None or at is not None:
            self.state.update((saved, last, json.dumps(few), json.dumps(pieces), at))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved, last, few, pieces, timer = self.state.get() if self.state.exists() else (None, None, "[]", "[]", None)
        few, pieces = json.loads(few), json.loads(pieces)
        number = max((n for _, n in pieces), default=0)
        for part in rows:
            # plain values: most tenants have few rows in a batch, for which a frame's operations cost more than the work
            columns = ([None if v is None or v != v else v for v in part[c].tolist()] for c in WAITING)
            requests = [list(r) for r in zip(*columns)]
            requests.sort(key=lambda r: (r[0], r[1] is None, r[1] or ""))
            for r in requests:
                r[5] = None if r[5] is None else int(r[5])
            if len(few) + len(requests) <= PIECE:
                few += requests
                continue
            for at in range(0, len(requests), PIECE):
                number += 1
                pieces.append([int(requests[at][0]), number])
                self.waiting.updateValue((number,), (json.dumps(requests[at : at + PIECE]),))
        pieces.sort()
        due = min([r[0] for r in few] + [p[0] for p in pieces[:1]]) // 1000 + 1
        self._keep(saved, last, few, pieces, timer, due if timer is None else min(due, timer))
        return iter(())

    def _take(self, few: list, pieces: list, now: int) -> list:
        """Requests before ``now`` in order, out of the few and the pieces that begin before it; both are brought up to
        date."""
        due, begun = [r for r in few if r[0] < now], [p for p in pieces if p[0] < now]
        few[:] = [r for r in few if r[0] >= now]
        for piece in begun:
            requests = json.loads(self.waiting.getValue((piece[1],))[0])
            rest = [r for r in requests if r[0] >= now]
            due += requests[: len(requests) - len(rest)]
            if rest:
                piece[0] = rest[0][0]
                self.waiting.updateValue((piece[1],), (json.dumps(rest),))
            else:
                pieces.remove(piece)
                self.waiting.removeKey((piece[1],))
        pieces.sort()
        return sorted(due, key=lambda r: (r[0], r[5] is None, r[1] or ""))

    def _decide(self, state: dict, due: list) -> np.ndarray:
        """Outcomes of the requests among the due rows, which releases part."""
        outcomes, start = [], 0
        for end in [*(i for i, r in enumerate(due) if r[5] is not None), len(due)]:
            if end > start:
                us, _, error, lock, _, _ = (np.array(c, dtype=object) for c in zip(*due[start:end]))
                none = np.zeros(len(us), dtype=bool)
                chunk = {"_us": us.astype(np.int64), "_error": error, "_lock": lock, "_refused": none}
                outcomes.append(self.machine.run(state, chunk)[1]["outcome"])
            if end < len(due) and state["locks"].get(due[end][3]) == due[end][5]:
                self.machine.locks.release(state["locks"], due[end][3])
            start = end + 1
        return np.concatenate(outcomes) if outcomes else np.empty(0, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        saved, last, few, pieces, _ = self.state.get()
        few, pieces = json.loads(few), json.loads(pieces)
        due = self._take(few, pieces, now)
        state = self.machine.start() if saved is None else self.machine.load(saved)
        if due:
            outcome, last = self._decide(state, due), max(int(due[-1][0]), last or 0)
            asked = [r for r in due if r[5] is None]
            if asked:
                us, request, error, lock, envelope, _ = (np.array(c, dtype=object) for c in zip(*asked))
                envelope[outcome != "accepted"] = None
                columns = [request, [key[0]] * len(asked), error, outcome, lock, envelope, us.astype(np.int64)]
                yield pd.DataFrame(dict(zip(OUTPUT.fieldNames(), columns)))
        ends = [] if last is None else [last + self.short_us, last + self.keep_us]
        if ends and now >= ends[1] and not pieces and not few:
            saved = last = None
        elif ends:
            if now >= ends[0]:
                state["throttle"]["short"].clear()
            saved = self.machine.dump(state)
        to_come = [r[0] for r in few] + [p[0] for p in pieces[:1]] + [e for e in ends if e > now]
        self._keep(saved, last, few, pieces, None, min(to_come) // 1000 + 1 if to_come else None)

    def close(self) -> None:
        pass


RELEASES = "organization_id string, ts timestamp, lock_key string, release_us string"


def _decided(
    requests: DataFrame, throttle: SlidingThrottle, locks: TtlLocks | None, delay: str, releases: DataFrame | None
) -> DataFrame:
    use_rocksdb(requests.sparkSession)
    rows = prepare(requests).withColumn("release_us", F.lit(None).cast("string"))
    if releases is not None:
        rows = rows.unionByName(releases, allowMissingColumns=True)
    # one watermark behind the union: a second one would hold it back for as long as nothing is released
    rows = rows.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).select("organization_id", "ts", *WAITING)
    return rows.groupBy("organization_id").transformWithStateInPandas(
        IntakeProcessor(throttle, locks or TtlLocks()), OUTPUT, "append", "EventTime"
    )


def intake_stream(
    requests: DataFrame, throttle: SlidingThrottle, locks: TtlLocks | None = None, delay: str = "10 minutes"
) -> DataFrame:
    return _decided(requests, throttle, locks, delay, None).drop("us")


def intake_with_queue(
    requests: DataFrame, throttle: SlidingThrottle, locks: TtlLocks | None, sink: Callable[[DataFrame, int], DataFrame],
    folder: str, told_at: Column | None = None, delay: str = "10 minutes",
) -> StreamingQuery:
    """Two-phase intake of everything available: label, then hand what is accepted to the queue, batch by batch.

    ``sink`` gets accepted envelopes (request_id, key, value) with the micro-batch's number, and gives back the
    request_ids that the queue refused. Those are labelled so under ``folder``/labelled, and go to ``folder``/refused,
    which the stream reads with its next batches: there they release the locks that they hold since their own instants,
    as of ``told_at`` (default: the time of the refusal). News older than the watermark comes too late. A micro-batch
    that is tried again replaces its own folders.
    """
    spark, told = requests.sparkSession, F.current_timestamp() if told_at is None else told_at
    releases = folder_stream(spark, f"{folder}/refused/*", RELEASES)
    decided = _decided(requests, throttle, locks, delay, releases)

    def each(batch: DataFrame, epoch: int) -> None:
        rows = f"{folder}/decided/{epoch}"
        batch.write.mode("overwrite").parquet(rows)
        batch = spark.read.schema(batch.schema).parquet(rows)
        accepted = batch.filter("outcome = 'accepted'")
        messages = accepted.select("request_id", F.col("organization_id").alias("key"), F.col("envelope").alias("value"))
        refused = sink(messages, epoch).select("request_id").distinct().withColumn("_refused", F.lit(True))
        marked = batch.join(refused, "request_id", "left")
        lost = (F.col("outcome") == "accepted") & F.col("_refused")
        told_apart = {
            "outcome": F.when(lost, "refused").otherwise(F.col("outcome")),
            "envelope": F.when(~F.coalesce(lost, F.lit(False)), F.col("envelope")),
        }
        labelled = marked.withColumns(told_apart).drop("us", "_refused")
        labelled.write.mode("overwrite").parquet(f"{folder}/labelled/epoch={epoch}")
        accepted.join(refused, "request_id", "left_semi").select(
            "organization_id", told.alias("ts"), "lock_key", F.col("us").cast("string").alias("release_us")
        ).write.mode("overwrite").parquet(f"{folder}/refused/{epoch}")

    # the stream reads a folder that must be there, also before the first refusal
    spark.createDataFrame([], RELEASES).write.mode("ignore").parquet(f"{folder}/refused/none")
    return decided.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
