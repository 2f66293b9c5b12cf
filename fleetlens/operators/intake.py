"""Job intake: validate, throttle, deduplicate, wrap for the queue.

Batch and streaming share the machines below; the streaming twin is in
``fleetlens.streaming.intake``. All instants are epoch micros.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.ids import job_signature, lock_key
from fleetlens.operators.segments import ROWS_PER_TASK
from fleetlens.operators.stateful import Machine, pack_instants, run_machine, unpack_instants
from fleetlens.operators.validate import first_error

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
NEVER = 2**62
DENSE = 64  # requests within a window from which on it pays to decide them together
DEFAULT_TTL = 300 * SECOND  # fixed value: default lock lifetime of five minutes


class SlidingThrottle:
    """Two sliding windows over admitted instants; a denied request is not recorded."""

    def __init__(self, limit_short: int, limit_long: int, short: int = MINUTE, long: int = HOUR):
        self.limit_short, self.limit_long, self.short, self.long = limit_short, limit_long, short, long

    def start(self) -> dict:
        return {"short": deque(), "long": deque()}

    def _expire(self, state: dict, now: int) -> None:
        for name, window in (("short", self.short), ("long", self.long)):
            held = state[name]
            while held and held[0] <= now - window:  # an instant exactly one window old has left
                held.popleft()

    def admit(self, state: dict, now: int) -> bool:
        self._expire(state, now)
        if len(state["short"]) >= self.limit_short or len(state["long"]) >= self.limit_long:
            return False
        state["short"].append(now)
        state["long"].append(now)
        return True

    def admit_all(self, state: dict, times: np.ndarray) -> np.ndarray:
        """What ``admit`` says to ascending instants one after the other.

        No admission frees a place within a window's length, so within such a stretch the places open by request j are
        known beforehand, b(j). With A(j) admissions up to it, A(j) = min(A(j - 1) + 1, b(j)), and so
        A(j) = j + min(1, min of b(i) - i over i <= j): one running minimum. Sparse stretches go request by request."""
        allowed = np.zeros(len(times), dtype=bool)
        width, i = min(self.short, self.long), 0
        while i < len(times):
            end = int(np.searchsorted(times, times[i] + width))
            if end - i < DENSE:
                end = min(len(times), i + DENSE)
                while i < end:
                    if self.admit(state, int(times[i])):
                        allowed[i] = True
                        i += 1
                    else:  # nothing is admitted before retry_at, so skip to it
                        i = max(i + 1, int(np.searchsorted(times, self.retry_at(state))))
                continue
            part = times[i:end]
            self._expire(state, int(part[0]))
            free = np.full(len(part), np.iinfo(np.int64).max)
            for name, window, limit in (("short", self.short, self.limit_short), ("long", self.long, self.limit_long)):
                held = np.array(state[name], dtype=np.int64)
                open_ = limit - len(held) + np.searchsorted(held, part - window, side="right")
                free = np.minimum(free, np.maximum(open_, 0))
            at = np.arange(len(part))
            admitted = at + np.minimum(1, np.minimum.accumulate(free - at))
            allowed[i:end] = np.diff(admitted, prepend=0) == 1
            for name in ("short", "long"):
                state[name].extend(part[allowed[i:end]].tolist())
            i = end
        return allowed

    def retry_at(self, state: dict) -> int:
        """Earliest instant at which a request denied now could be admitted; a limit of nothing never admits."""
        if min(self.limit_short, self.limit_long) <= 0:
            return NEVER
        waits = []
        if len(state["short"]) >= self.limit_short:
            waits.append(state["short"][0] + self.short)
        if len(state["long"]) >= self.limit_long:
            waits.append(state["long"][0] + self.long)
        return max(waits)

    def dump(self, state: dict) -> list:
        return [list(state["short"]), list(state["long"])]

    def load(self, saved: list) -> dict:
        return {"short": deque(saved[0]), "long": deque(saved[1])}


class TtlLocks:
    """First holder of a key keeps it for ``ttl`` after its own instant."""

    def __init__(self, ttl: int = DEFAULT_TTL):
        self.ttl = ttl

    def start(self) -> dict:
        return {}

    def acquire(self, state: dict, key: str, now: int) -> bool:
        while state:  # instants only grow, so the oldest lock comes first
            oldest = next(iter(state))
            if state[oldest] + self.ttl > now:
                break
            del state[oldest]
        if key in state:
            return False
        state[key] = now
        return True

    def release(self, state: dict, key: str) -> None:
        del state[key]

    def dump(self, state: dict) -> list:
        return [[k, t] for k, t in state.items()]

    def load(self, saved: list) -> dict:
        return dict(saved)


class NoThrottle(SlidingThrottle):
    """Strategy that admits everything."""

    def __init__(self):
        super().__init__(1, 1)

    def admit(self, state: dict, now: int) -> bool:
        return True

    def admit_all(self, state: dict, times: np.ndarray) -> np.ndarray:
        return np.ones(len(times), dtype=bool)


class ThrottleMachine(Machine):
    columns = ["_us"]
    output = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType())])

    def __init__(self, rule: SlidingThrottle):
        self.rule = rule

    def start(self):
        return self.rule.start()

    def dump(self, state):
        return json.dumps(self.rule.dump(state))

    def load(self, text):
        return self.rule.load(json.loads(text))

    def run(self, state, chunk):
        times = chunk["_us"]
        self.rule._expire(state, int(times[0]))
        held = np.array(state["short"], dtype=np.int64)
        allowed = self.rule.admit_all(state, times)
        self.rule._expire(state, int(times[-1]))
        admitted = np.concatenate([held, times[allowed]])
        in_window = len(held) + np.cumsum(allowed) - np.searchsorted(admitted, times - self.rule.short, side="right")
        return state, {"allowed": allowed, "remaining": np.maximum(self.rule.limit_short - in_window, 0)}

    def page(self, chunk):
        return pack_instants(chunk["_us"])

    def carry(self, state, page):
        self.rule.admit_all(state, times := unpack_instants(page))
        self.rule._expire(state, int(times[-1]))
        return state


class LockMachine(Machine):
    """State is the instant of the current holder."""

    columns = ["_us"]
    output = T.StructType([T.StructField("acquired", T.BooleanType())])

    def __init__(self, ttl: int):
        self.ttl = ttl

    def start(self):
        return None

    def dump(self, state):
        return json.dumps(state)

    def load(self, text):
        return json.loads(text)

    def run(self, state, chunk):
        times, n = chunk["_us"], len(chunk["_us"])
        acquired = np.zeros(n, dtype=bool)
        i = 0 if state is None else int(np.searchsorted(times, state + self.ttl))
        while i < n:
            acquired[i] = True
            state = int(times[i])
            i = max(i + 1, int(np.searchsorted(times, state + self.ttl)))
        return state, {"acquired": acquired}

    def page(self, chunk):
        """Rows to (instant, last holder): a lock that is free by that instant, and not by the row before, ends there.

        A row that takes the lock passes it on to the first row a lifetime later; pointers are doubled until each row
        knows the last holder that it leads to. Rows beyond the first lifetime can't be the first to take it."""
        times = chunk["_us"]
        at = np.arange(len(times))
        after = np.maximum(at + 1, np.searchsorted(times, times + self.ttl))
        last = np.where(after < len(times), after, at)
        while (last[last] != last).any():
            last = last[last]
        first = int(np.searchsorted(times, times[0] + self.ttl, side="right"))
        root = last[: first + 1]
        turn = np.append(np.flatnonzero(root[1:] != root[:-1]), len(root) - 1)  # the last row that leads to each holder
        return np.stack([times[turn], times[root[turn]]]).tobytes()

    def carry(self, state, page):
        takes, leads = np.frombuffer(page, np.int64).reshape(2, -1)
        at = 0 if state is None else int(np.searchsorted(takes, state + self.ttl))
        return int(leads[at]) if at < len(takes) else state


class TokenBucketMachine(Machine):
    """``refill`` tokens arrive at every multiple of ``period``, up to ``capacity``."""

    columns = ["_us"]
    output = T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.LongType())])

    def __init__(self, capacity: int, refill: int, period: int):
        self.capacity, self.refill, self.period = capacity, refill, period

    def start(self):
        return None

    def dump(self, state):
        # a full bucket is full whenever it was last touched
        return json.dumps(None if state is None or state[0] >= self.capacity else state)

    def load(self, text):
        return json.loads(text)

    def run(self, state, chunk):
        ticks, first = np.unique(chunk["_us"] // self.period, return_index=True)
        sizes = np.diff(np.append(first, len(chunk["_us"])))
        allowed = np.zeros(len(chunk["_us"]), dtype=bool)
        left = np.zeros(len(chunk["_us"]), dtype=np.int64)
        for tick, a, size in zip(ticks.tolist(), first.tolist(), sizes.tolist()):
            tokens, last = state or (self.capacity, tick)
            tokens = min(self.capacity, tokens + self.refill * (tick - last))
            granted = min(tokens, size)
            allowed[a : a + granted] = True
            left[a : a + granted] = np.arange(tokens - 1, tokens - granted - 1, -1)
            state = [tokens - granted, tick]
        return state, {"allowed": allowed, "tokens": left}

    def page(self, chunk):
        """First and last tick, and (low, high, add): tokens x at the first leave min(high, max(low, x + add)) after the
        last. Each tick is such a map, and two of them are one again, so they are joined pairwise."""
        ticks, first = np.unique(chunk["_us"] // self.period, return_index=True)
        sizes = np.diff(np.append(first, len(chunk["_us"])))
        add = self.refill * np.diff(ticks, prepend=ticks[0]) - sizes
        low, high = np.zeros_like(add), np.maximum(self.capacity - sizes, 0)
        while len(add) > 1:
            odd = [a[-1:] if len(a) % 2 else a[:0] for a in (low, high, add)]
            (l1, h1, a1), (l2, h2, a2) = ([a[k : len(add) // 2 * 2 : 2] for a in (low, high, add)] for k in (0, 1))
            bound = lambda x: np.minimum(h2, np.maximum(l2, x + a2))  # noqa: B023, E731
            low, high, add = (np.append(a, o) for a, o in zip((bound(l1), bound(h1), a1 + a2), odd))
        return np.array([ticks[0], ticks[-1], low[0], high[0], add[0]], dtype=np.int64).tobytes()

    def carry(self, state, page):
        first, last, low, high, add = np.frombuffer(page, np.int64).tolist()
        tokens, before = state or (self.capacity, first)
        tokens = min(self.capacity, tokens + self.refill * (first - before))
        return [min(high, max(low, tokens + add)), last]


class IntakeMachine(Machine):
    """Throttle, then lock, for one tenant; a duplicate still uses quota.

    A request that the queue refused gives its lock back at once, so the next one like it may try; its quota is used."""

    columns = ["_us", "_error", "_lock", "_refused"]
    output = T.StructType([T.StructField("outcome", T.StringType())])

    def __init__(self, throttle: SlidingThrottle, locks: TtlLocks):
        self.throttle, self.locks = throttle, locks

    def start(self):
        return {"throttle": self.throttle.start(), "locks": self.locks.start()}

    def dump(self, state):
        return json.dumps([self.throttle.dump(state["throttle"]), self.locks.dump(state["locks"])])

    def load(self, text):
        throttle, locks = json.loads(text)
        return {"throttle": self.throttle.load(throttle), "locks": self.locks.load(locks)}

    def decide(self, state, now: int, error: str | None, key: str, refused: bool = False) -> str:
        if error is not None:
            return "invalid"
        if not self.throttle.admit(state["throttle"], now):
            return "throttled"
        if not self.locks.acquire(state["locks"], key, now):
            return "duplicate"
        if refused:
            self.locks.release(state["locks"], key)
            return "refused"
        return "accepted"

    def run(self, state, chunk):
        valid = np.flatnonzero(pd.isna(chunk["_error"]))
        outcome = np.full(len(chunk["_us"]), "invalid", dtype=object)
        if len(valid):
            outcome[valid] = self._decided(state, *(chunk[c][valid] for c in ("_us", "_lock", "_refused")))
        return state, {"outcome": outcome}

    def _decided(self, state, times, locks, refused) -> np.ndarray:
        """Outcomes of valid requests: quota first, which does not depend on locks, then locks of the admitted."""
        out = np.full(len(times), "throttled", dtype=object)
        for i in np.flatnonzero(self.throttle.admit_all(state["throttle"], times)).tolist():
            now, key = int(times[i]), locks[i]
            if not self.locks.acquire(state["locks"], key, now):
                out[i] = "duplicate"
            elif refused[i]:
                self.locks.release(state["locks"], key)
                out[i] = "refused"
            else:
                out[i] = "accepted"
        self.throttle._expire(state["throttle"], int(times[-1]))
        return out

    def page(self, chunk):
        valid = np.flatnonzero(pd.isna(chunk["_error"]))
        if not len(valid):
            return b""
        locks = pa.array(chunk["_lock"][valid], pa.string())
        batch = pa.RecordBatch.from_arrays([locks, pa.array(chunk["_refused"][valid].astype(bool))], ["lock", "refused"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        times = pack_instants(chunk["_us"][valid])
        return len(times).to_bytes(8, "little") + times + sink.getvalue().to_pybytes()

    def carry(self, state, page):
        if page:
            end = 8 + int.from_bytes(page[:8], "little")
            rest = pa.ipc.open_stream(page[end:]).read_all()
            locks, refused = (rest.column(c).to_numpy() for c in ("lock", "refused"))
            self._decided(state, unpack_instants(page[8:end]), locks, refused)
        return state


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def throttle(
    df: DataFrame, by: list[str], ts: str, tie: str, limit_short: int, limit_long: int,
    short: int = MINUTE, long: int = HOUR, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Admission per tenant in time order, with what is left of the short window."""
    machine = ThrottleMachine(SlidingThrottle(limit_short, limit_long, short, long))
    rows = df.withColumn("_us", _micros(ts))
    return run_machine(rows, by, ["_us", tie], machine, rows_per_task).drop("_us")


def dedup_ttl(
    df: DataFrame, by: list[str], ts: str, tie: str, ttl: int = DEFAULT_TTL, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The first row per key wins until ``ttl`` after it; later rows do not extend the lock."""
    rows = df.withColumn("_us", _micros(ts))
    return run_machine(rows, by, ["_us", tie], LockMachine(ttl), rows_per_task).drop("_us")


def token_bucket(
    df: DataFrame, by: list[str], ts: str, tie: str, capacity: int = 100, refill: int = 100,
    period: int = 10 * SECOND, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    machine = TokenBucketMachine(capacity, refill, period)
    rows = df.withColumn("_us", _micros(ts))
    return run_machine(rows, by, ["_us", tie], machine, rows_per_task).drop("_us")


REQUEST_SCHEMA = (
    "request_id string, ts timestamp, organization_id string, job_type string, prompt string, "
    "parameters map<string,string>, payload string, timeout_seconds int, callback_url string"
)


def _missing(c: str) -> Column:
    """Protocol scalars have no null: empty means missing."""
    return F.coalesce(F.col(c), F.lit("")) == ""


def request_rules() -> list[tuple[Column, str]]:
    # fixed values: the rejection messages
    return [
        (_missing("organization_id"), "organization_id is required"),
        (_missing("job_type"), "job_type is required"),
        (_missing("prompt") & _missing("payload"), "either prompt or payload is required"),
        (F.coalesce(F.col("timeout_seconds"), F.lit(0)) <= 0, "timeout_seconds must be positive"),
    ]


def envelope() -> Column:
    """Queue message body. The job id derives from the request id, so replays agree."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.to_json(
        F.struct(
            F.sha2(F.col("request_id").cast("string"), 256).alias("job_id"),
            text("organization_id").alias("organization_id"),
            text("job_type").alias("job_type"),
            text("prompt").alias("prompt"),
            F.col("parameters"),
            text("payload").alias("payload"),
            F.coalesce(F.col("timeout_seconds"), F.lit(0)).alias("timeout_seconds"),
            text("callback_url").alias("callback_url"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        ),
        {"ignoreNullFields": "false"},
    )


def prepare(requests: DataFrame) -> DataFrame:
    """What the machines need of a request, computed in the JVM."""
    return requests.select(
        "request_id",
        "ts",
        "organization_id",
        first_error(request_rules()).alias("error"),
        lock_key("organization_id", "job_type", job_signature("prompt", "job_type", "payload", "parameters")).alias(
            "lock_key"
        ),
        envelope().alias("envelope"),
    )


def intake(
    requests: DataFrame, limiter: SlidingThrottle, locks: TtlLocks | None = None,
    rows_per_task: int = ROWS_PER_TASK, refused: DataFrame | None = None,
) -> DataFrame:
    """Label every request accepted, invalid, throttled or duplicate; one shuffle by tenant.

    ``refused`` (request_id) names requests that the queue did not take. They release their locks and are labelled so.
    """
    rows = prepare(requests).withColumns(
        {"_us": _micros("ts"), "_error": F.col("error"), "_lock": F.col("lock_key")}
    )
    if refused is None:
        rows = rows.withColumn("_refused", F.lit(False))
    else:
        failed = refused.select("request_id").distinct().withColumn("_refused", F.lit(True))
        rows = rows.join(failed, "request_id", "left").withColumn("_refused", F.coalesce("_refused", F.lit(False)))
    machine = IntakeMachine(limiter, locks or TtlLocks())
    labelled = run_machine(rows, ["organization_id"], ["_us", "request_id"], machine, rows_per_task)
    return labelled.drop("_us", "_error", "_lock", "_refused").withColumn(
        "envelope", F.when(F.col("outcome") == "accepted", F.col("envelope"))
    )


def enqueue(accepted: DataFrame, sink: Callable[[DataFrame], None]) -> None:
    """Hand accepted envelopes to a queue writer as (key, value)."""
    sink(
        accepted.filter(F.col("outcome") == "accepted").select(
            F.col("organization_id").cast("string").alias("key"), F.col("envelope").alias("value")
        )
    )
