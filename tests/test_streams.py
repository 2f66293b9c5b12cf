"""Streams in several micro-batches against their batch twins, and state expiry."""

import json
import random
import time
from contextlib import nullcontext, suppress
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fleetlens.operators import slo, tracking
from fleetlens.operators.intake import REQUEST_SCHEMA, IntakeMachine, SlidingThrottle, TtlLocks, intake
from fleetlens.plans.registry import QUERIES
from fleetlens.sources import queue
from fleetlens.streaming.intake import WAITING, IntakeProcessor, intake_stream
from fleetlens.streaming.metrics import alert_stream, counter_stream
from fleetlens.streaming.runs import (
    CHECKPOINT_FILES, SOURCE_LOG_DELAY, folder_stream, new_folder, plain_checkpoints, run_to_end,
)
from fleetlens.streaming.tracking import ChangeProcessor, change_stream, correlate_stream, job_state_stream

T0 = datetime(2024, 1, 1)


def in_steps(spark, rows, schema, parts):
    """Rows in order as one file per micro-batch."""
    path = new_folder(spark, "steps")
    size = -(-len(rows) // parts)
    for a in range(0, len(rows), size):
        spark.createDataFrame(rows[a : a + size], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return folder_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(11)
    rows, t = [], 0
    for i in range(160):
        t += rng.randrange(60)
        rows.append(
            (f"r{i:04d}", T0 + timedelta(seconds=t), rng.choice(["acme", "acme", "acme", "zeta"]), "sync", f"p{rng.randrange(5)}",
             {"a": "1"}, "", rng.choice([30, 30, 30, 0]), "")
        )
    return rows


@pytest.mark.parametrize("mixed", [1, 8])
def test_intake_over_micro_batches(spark, requests, mixed):
    """Also with requests out of order, as long as the watermark's delay lasts."""
    rules, rng = lambda: SlidingThrottle(2, 30), random.Random(3)
    shuffled = [r for a in range(0, len(requests), mixed) for r in rng.sample(requests[a : a + mixed], len(requests[a : a + mixed]))]
    close = ("z", T0 + timedelta(days=5), "closing", "sync", "p", {"a": "1"}, "", 30, "")
    stream = intake_stream(in_steps(spark, [*shuffled, close], REQUEST_SCHEMA, 7), rules(), TtlLocks())
    got = {r["request_id"]: (r["outcome"], r["error"], r["envelope"]) for r in run_to_end(stream, "intake").collect()}
    batch = intake(spark.createDataFrame(requests, REQUEST_SCHEMA), rules(), TtlLocks())
    want = {r["request_id"]: (r["outcome"], r["error"], r["envelope"]) for r in batch.collect()}
    assert got == want and {v[0] for v in want.values()} == {"accepted", "invalid", "throttled", "duplicate"}


def test_idle_tenant_is_forgotten(spark, requests):
    late = ("r9999", T0 + timedelta(days=5), "late", "sync", "p", {"a": "1"}, "", 30, "")
    end = [(f"z{d}", T0 + timedelta(days=d), "last", "sync", "p", {"a": "1"}, "", 30, "") for d in (9, 20)]
    stream = intake_stream(in_steps(spark, [*requests[:6], late, *end], REQUEST_SCHEMA, 9), SlidingThrottle(2, 30))
    out = new_folder(spark, "idle")
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "intake").load(out + "-c")
    assert {r[0] for r in held.select("key.organization_id").collect()} == {"last"}


def test_windows_of_an_idle_tenant_expire_apart(spark):
    row = lambda i, m, org: (i, T0 + timedelta(minutes=m), org, "sync", "p", {"a": "1"}, "", 30, "")
    rows = [row("a", 0, "idle"), row("b", 30, "x"), row("c", 40, "x"), row("d", 45, "x")]
    stream = intake_stream(in_steps(spark, rows, REQUEST_SCHEMA, 4), SlidingThrottle(2, 30))
    out = new_folder(spark, "apart")
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "intake").load(out + "-c")
    saved = {r[0]: json.loads(r[1]) for r in held.select("key.organization_id", "value.saved").collect()}
    (short, long), _ = saved["idle"]
    assert short == [] and len(long) == 1


def test_changes_over_micro_batches(spark):
    rng = random.Random(2)
    polls = []
    for poll in range(60):
        run = poll % 3
        for job in range(2):
            polls.append((run, poll, "in_progress", None, job, job, f"job{job}", rng.choice(["queued", "in_progress"]), rng.choice([None, "failure"])))
    schema = "run_id long, poll long, run_status string, run_conclusion string, listing_pos int, job_id long, name string, status string, conclusion string"
    out = run_to_end(change_stream(in_steps(spark, polls, schema, 5)), "changes").filter("kind = 'log'")
    got = sorted((r["run_id"], r["poll"], r["line"], r["level"]) for r in out.collect())
    batch = tracking.change_events(spark.createDataFrame(polls, schema), ["run_id", "job_id"], ["poll"])
    assert got == sorted((r["run_id"], r["poll"], r["line"], r["level"]) for r in batch.collect())


def test_alerts_and_counters_over_micro_batches(spark):
    rng = random.Random(4)
    seconds = sorted(rng.randrange(7200) for _ in range(150))
    rows = [(rng.choice("ab"), T0 + timedelta(seconds=s)) for s in seconds]
    closed = [*rows, ("z", T0 + timedelta(days=2)), ("z", T0 + timedelta(days=2, seconds=1))]
    step = 300
    tick = F.unix_timestamp("ts") - F.unix_timestamp("ts") % step
    batch = spark.createDataFrame(rows, "k string, ts timestamp").groupBy("k", tick.alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    stream = run_to_end(counter_stream(in_steps(spark, closed, "k string, ts timestamp", 6), "k", "300 seconds"), "counters")
    counted = stream.filter("k <> 'z'").select("k", F.unix_timestamp("window_start").alias("tick"), "n")
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in batch.collect()}
    states = run_to_end(alert_stream(in_steps(spark, closed, "k string, ts timestamp", 6), "k", step, 600, F.col("n") >= 3), "alerts")
    want = slo.alert_states(batch.select("k", "tick", (F.col("n") >= 3).alias("active")), ["k"], step, 600)
    key = lambda df: {(r["k"], r["tick"], r["state"]) for r in df.collect()}
    assert key(states.filter("k <> 'z'")) == key(want)


def test_correlation_times_out(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    d = [("m", 1, at(0)), ("m", 2, at(100)), ("n", 3, at(0)), ("m", 99, at(10**6))]
    r = [("m", 10, 7, at(-30)), ("m", 11, 3, at(90)), ("m", 12, 1, at(191)), ("m", 98, 1, at(10**6))]
    stream = correlate_stream(
        in_steps(spark, d, "b string, dispatch_id long, ts timestamp", 2), in_steps(spark, r, "b string, run_id long, listing_pos long, ts timestamp", 2), "b"
    )
    got = {x["dispatch_id"]: (x["run_id"], x["phase"]) for x in run_to_end(stream, "correlate").collect()}
    assert got == {1: (11, "syncing"), 2: (11, "syncing"), 3: (None, "failed")}


def test_job_life_cycle(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        (1, at(0), "PENDING", 60), (2, at(1), "PENDING", 60), (3, at(2), "PENDING", 60), (1, at(10), "RUNNING", 60), (2, at(11), "RUNNING", 60),
        (1, at(20), "COMPLETED", 60), (3, at(21), "CANCELLED", 60), (1, at(30), "RUNNING", 60), (0, at(31), "UNSPECIFIED", 60), (0, at(32), "RUNNING", 60),
        (0, at(33), "SOMETHING_NEW", 60), (4, at(9000), "PENDING", 60), (5, at(99999), "PENDING", 60), (5, at(999999), "PENDING", 60),
    ]
    stream = job_state_stream(in_steps(spark, rows, "job_id long, ts timestamp, status string, timeout_seconds int", 5))
    out = sorted((r["job_id"], r["ts"], r["status"]) for r in run_to_end(stream, "jobs").collect() if r["job_id"] < 4)
    assert [(j, s) for j, _, s in out] == [
        (0, "UNSPECIFIED"), (0, "RUNNING"), (0, "TIMEOUT"), (1, "PENDING"), (1, "RUNNING"), (1, "COMPLETED"), (2, "PENDING"), (2, "RUNNING"), (2, "TIMEOUT"), (3, "PENDING"), (3, "CANCELLED"),
    ]


class Store:
    """The state of one tenant in memory, with a count of the waiting requests that were read."""

    def __init__(self):
        self.values, self.timers, self.read = {}, set(), 0

    def getValueState(self, name, schema):
        return Value(self.values, name)

    def getMapState(self, name, key, value):
        return self

    def getValue(self, key):
        self.read += len(json.loads(self.values[key][0]))
        return self.values[key]

    def updateValue(self, key, value):
        self.values[key] = value

    def removeKey(self, key):
        del self.values[key]

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Value:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values[self.name]

    def update(self, value):
        self.values[self.name] = value

    def clear(self):
        self.values.pop(self.name, None)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_hot_tenant_reads_due_requests_only():
    """20,000 requests of one tenant in 200 micro-batches, each shuffled, ten minutes of which always wait."""
    rng = random.Random(2)
    requests = [(10**6 * 1000 + i * 60_000 + rng.randrange(60_000), f"r{i:05}", None, f"k{rng.randrange(50)}", "e", None) for i in range(20_000)]
    store, out = Store(), []
    p = IntakeProcessor(SlidingThrottle(20, 600), TtlLocks())
    p.init(store)
    for a in range(0, len(requests), 100):
        part = rng.sample(requests[a : a + 100], 100)
        assert list(p.handleInputRows(("o",), iter([pd.DataFrame(part, columns=WAITING)]), None)) == []
        ms = (max(r[0] for r in part) - 600 * 10**6) // 1000
        for end in (False, a + 100 == len(requests)):
            ms = 10**12 if end else ms
            while due := [t for t in store.timers if t <= ms]:
                assert len(store.timers) == 1
                store.timers.remove(due[0])
                out += [r for frame in p.handleExpiredTimer(("o",), Watermark(ms), None) for r in frame.itertuples(index=False)]
    machine = IntakeMachine(SlidingThrottle(20, 600), TtlLocks())
    state = machine.start()
    want = [(r[1], machine.decide(state, r[0], None, r[3])) for r in sorted(requests)]
    assert [(r.request_id, r.outcome) for r in out] == want
    assert {o for _, o in want} == {"accepted", "throttled", "duplicate"}
    # due requests, and at most two pieces a trigger that the watermark stands in; all that waits would be two million
    assert store.read <= len(requests) + 200 * 2 * 100
    assert not store.values and not store.timers


def test_a_release_gives_back_the_lock_it_knows(spark):
    at = lambda s: (T0 + timedelta(seconds=s))
    us = lambda s: int((at(s) - datetime(1970, 1, 1)).total_seconds()) * 10**6
    p, store = IntakeProcessor(SlidingThrottle(100, 100), TtlLocks(300 * 10**6)), Store()
    p.init(store)
    rows = [(us(0), "a", None, "k", "e", None), (us(10), "b", None, "k", "e", None), (us(20), None, None, "k", None, str(us(0))),
            (us(20), "c", None, "k", "e", None), (us(30), None, None, "k", None, str(us(0))), (us(40), "d", None, "k", "e", None)]
    list(p.handleInputRows(("o",), iter([pd.DataFrame(rows, columns=WAITING)]), None))
    frame = pd.concat(p.handleExpiredTimer(("o",), Watermark(us(100) // 1000), None))
    assert dict(zip(frame.request_id, frame.outcome)) == {"a": "accepted", "b": "duplicate", "c": "accepted", "d": "duplicate"}


def test_many_polls_of_a_run_are_plain_work():
    """20,000 polls of a job; a frame for each of them would take most of a minute."""
    p, store = ChangeProcessor(), Store()
    p.init(store)
    store.iterator = lambda: iter(())
    polls = pd.DataFrame({
        "poll": range(20_000), "listing_pos": 0, "job_id": 1, "name": "build", "status": ["queued", "in_progress"] * 10_000,
        "conclusion": None, "run_status": "in_progress", "run_conclusion": None,
    })
    start = time.process_time()
    out = pd.concat(p.handleInputRows((1,), iter([polls.sample(frac=1, random_state=1)]), None))
    assert time.process_time() - start < 2
    assert list(out.poll) == [i for i in range(20_000) for _ in "ab"] and set(out.kind) == {"log", "status"}
    assert store.values == {(1,): ("in_progress", None)}


class CountedValue(Value):
    def __init__(self, values, name, counts):
        super().__init__(values, name)
        self.counts = counts

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "clear"):
            self.counts.append(name)
        return super().__getattribute__(name)


def test_a_small_tenant_takes_few_accesses():
    """Every access of state is a round trip: three and a timer for new requests, two and a timer for due ones."""
    store, counts = Store(), []
    store.getValueState = lambda name, schema: CountedValue(store.values, name, counts)
    p = IntakeProcessor(SlidingThrottle(100, 100), TtlLocks())
    p.init(store)
    rows = [(10**12 + i, f"r{i}", None, f"k{i}", "e", None) for i in range(50)]
    for part in (rows[30:], rows[:30]):
        list(p.handleInputRows(("o",), iter([pd.DataFrame(part, columns=WAITING)]), None))
    assert len(counts) == 2 + 3 and list(store.values) == ["intake"]
    counts.clear()
    frame = pd.concat(p.handleExpiredTimer(("o",), Watermark(10**9 + 1), None))
    assert list(frame.request_id) == [r[1] for r in rows] and set(frame.outcome) == {"accepted"}
    assert len(counts) == 2 and store.read == 0


def test_plain_checkpoints_go_on_where_a_stream_failed(spark):
    path, checkpoint = new_folder(spark, "rows"), new_folder(spark, "checkpoint")
    settings = lambda: [spark.conf.get(k, None) for k in (CHECKPOINT_FILES, SOURCE_LOG_DELAY)]
    before, seen = settings(), []
    spark.range(4).repartitionByRange(4, "id").write.parquet(path)

    def run(fails=False):
        def each(batch, epoch):
            seen.append((epoch, [r["id"] for r in batch.collect()]))
            if fails:
                raise RuntimeError("the worker is lost")

        stream = folder_stream(spark, path, "id long", files_per_batch=1).writeStream.foreachBatch(each)
        query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        with suppress(StreamingQueryException) if fails else nullcontext():
            query.awaitTermination()

    with plain_checkpoints(spark, checkpoint):
        assert settings()[0].endswith("FileSystemBasedCheckpointFileManager") and settings()[1] == "0"
        run(fails=True)
        run()
    assert settings() == before
    # Spark's own logs go on from those
    spark.range(4, 5, numPartitions=1).write.mode("append").parquet(path)
    run()
    assert seen[0] == seen[1] and [epoch for epoch, _ in seen] == [0, 0, 1, 2, 3, 4]
    assert sorted(i for _, ids in seen[1:] for i in ids) == [0, 1, 2, 3, 4]


def test_plain_checkpoints_leave_what_the_session_sets(spark):
    spark.conf.set(SOURCE_LOG_DELAY, "600000")
    try:
        with plain_checkpoints(spark, new_folder(spark, "checkpoint")):
            assert spark.conf.get(SOURCE_LOG_DELAY) == "600000"
        assert spark.conf.get(SOURCE_LOG_DELAY) == "600000"
    finally:
        spark.conf.unset(SOURCE_LOG_DELAY)


def test_bounded_fetches_have_plain_checkpoints(spark, tmp_path, monkeypatch):
    columns = ["id AS o_orderkey", "if(id % 3 = 0, NULL, 1) AS o_custkey", "'O' AS o_orderstatus"]
    spark.range(90_000, numPartitions=1).selectExpr(*columns).write.parquet(f"{tmp_path}/orders.parquet")
    read, asked = queue.read_jobs_stream, []

    def asks(*args, **limits):
        asked.append((limits["fetch_limit"], limits["per_file"], spark.conf.get(CHECKPOINT_FILES, "")))
        return read(*args, **limits)

    monkeypatch.setattr(queue, "read_jobs_stream", asks)
    rows = QUERIES["s2_bounded_fetch"](spark, str(tmp_path)).collect()
    assert sorted(r["o_orderkey"] for r in rows) == list(range(90_000)) and all(r["within"] for r in rows)
    # each consumer fails once and is started again
    assert len(asked) == 2 * 2 * spark.sparkContext.defaultParallelism
    assert all(a[:2] == (4000, 1000) and a[2].endswith("FileSystemBasedCheckpointFileManager") for a in asked)
