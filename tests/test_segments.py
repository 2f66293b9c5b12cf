"""Segmented scans and state machines against plain Python, split and unsplit."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators.intake import (
    HOUR,
    IntakeMachine,
    SlidingThrottle,
    TtlLocks,
    dedup_ttl,
    intake,
    throttle,
    token_bucket,
)
from fleetlens.operators.segments import Scan, ranged, running, scan, split
from fleetlens.plans.registry import BUILDS
from fleetlens.sources.tables import Tables

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """One key holds most rows; some instants are shared by many rows; one key is null."""
    rng = random.Random(5)
    out, i = [], 0
    for key, n in (("hot", 400), ("b", 30), (None, 20), ("one", 1)):
        for _ in range(n):
            t = 5000 if key == "hot" and rng.random() < 0.3 else rng.randrange(20000)
            out.append((i, key, T0 + timedelta(seconds=t), rng.choice([None, 1.0, 2.0, 3.0]), "k%d" % rng.randrange(3)))
            i += 1
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, v double, lock string").repartition(5)


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


@pytest.mark.parametrize("limit", [10**9, 40, 7])
@pytest.mark.parametrize("reverse", [False, True])
def test_scans(df, rows, limit, reverse):
    cols = {
        "n": Scan("row_number"),
        "total": Scan("sum", F.col("v")),
        "top": Scan("max", F.col("v")),
        "low": Scan("min", F.col("v")),
        "seen": Scan("last", F.col("v")),
        "prev": Scan("lag", F.col("v")),
    }
    got = {
        r["id"]: (r["n"], r["total"], r["top"], r["low"], r["seen"], r["prev"])
        for r in running(df, ["key"], ["ts", "id"], cols, limit, reverse).collect()
    }
    want = {}
    for group in by_key(rows).values():
        seen, prev = [], None
        for n, r in enumerate(reversed(group) if reverse else group, 1):
            seen += [r[3]] if r[3] is not None else []
            want[r[0]] = (
                n, sum(seen) if seen else None, max(seen, default=None), min(seen, default=None),
                seen[-1] if seen else None, prev,
            )
            prev = r[3]
    assert got == want


def test_hot_key_is_cut_even_at_one_instant(df):
    s = split(df, ["key"], ["ts", "id"], 40)
    sizes = s.df.groupBy("key", "_seg").count().collect()
    assert max(r["count"] for r in sizes) <= 80
    assert {r["_seg"] for r in sizes if r["key"] != "hot"} == {0}


def test_text_order_is_cut(spark):
    """Half of the rows share one instant, and their order is a text with a long common start."""
    df = spark.range(400).select(F.lit("k").alias("k"), (F.col("id") % 2 * F.col("id")).alias("t"), F.format_string("request-%06d", "id").alias("rid"))
    s = split(df, ["k"], ["t", "rid"], 30)
    assert s.df.groupBy("_seg").count().agg(F.max("count")).first()[0] <= 60
    got = running(df, ["k"], ["t", "rid"], {"n": Scan("row_number")}, 30).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: (r["t"], r["rid"]))] == list(range(1, 401))


def test_global_order_without_key(df, rows):
    got = running(df, [], ["ts", "id"], {"n": Scan("row_number")}, 50).select("id", "n").collect()
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}
    assert {r["id"]: r["n"] for r in got} == want


@pytest.mark.parametrize("lo,hi", [(-300, 90), (-300, 0), (0, 7), (50, 400)])
def test_ranged(df, rows, lo, hi):
    at = F.unix_timestamp("ts")
    cols = {"n": Scan("count", F.lit(1)), "top": Scan("max", F.col("v")), "low": Scan("min", F.col("v")), "total": Scan("sum", F.col("v"))}
    got = ranged(df, ["key"], at, lo, hi, cols)
    want = {}
    for group in by_key(rows).values():
        for r in group:
            near = [o for o in group if lo <= (o[2] - r[2]).total_seconds() <= hi]
            values = [o[3] for o in near if o[3] is not None]
            want[r[0]] = (len(near), max(values, default=None), min(values, default=None), sum(values) if values else None)
    assert {r["id"]: (r["n"] or 0, r["top"], r["low"], r["total"]) for r in got.collect()} == want


def test_ranged_inside_a_full_range(df, rows):
    """Instants by the microsecond: one range's width holds more rows of a key than a task should."""
    at = F.unix_micros("ts")
    cols = {"n": Scan("count", F.lit(1)), "top": Scan("max", F.struct("v", "id")), "low": Scan("min", F.col("v")), "total": Scan("sum", F.col("v"))}
    for lo, hi in ((-3000, 900), (0, 700)):
        plain = ranged(df, ["key"], at, lo * 10**6, hi * 10**6, cols, 10**12).select("id", *cols)
        cut = ranged(df, ["key"], at, lo * 10**6, hi * 10**6, cols, 30).select("id", *cols)
        assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def brute_throttle(rows, ls, ll, short, long):
    want = {}
    for group in by_key(rows).values():
        held = []
        for r in group:
            s = sum(1 for t in held if t > r[2] - timedelta(seconds=short))
            l = sum(1 for t in held if t > r[2] - timedelta(seconds=long))
            ok = s < ls and l < ll
            if ok:
                held.append(r[2])
                s += 1
            want[r[0]] = (ok, max(ls - s, 0))
    return want


@pytest.mark.parametrize("limit,parts", [(10**9, 1), (10**9, 4), (10**9, 17), (110, 4)])
def test_throttle(df, rows, limit, parts):
    got = throttle(df.repartition(parts), ["key"], "ts", "id", 3, 8, 60 * 10**6, HOUR, rows_per_task=limit)
    assert {r["id"]: (r["allowed"], r["remaining"]) for r in got.collect()} == brute_throttle(rows, 3, 8, 60, 3600)


@pytest.mark.parametrize("limit", [10**9, 60])
def test_dedup(df, rows, limit):
    got = dedup_ttl(df, ["key", "lock"], "ts", "id", 300 * 10**6, limit)
    want, held = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        k = (r[1], r[4])
        ok = k not in held or r[2] >= held[k] + timedelta(seconds=300)
        if ok:
            held[k] = r[2]
        want[r[0]] = ok
    assert {r["id"]: r["acquired"] for r in got.collect()} == want


@pytest.mark.parametrize("limit", [10**9, 110])
def test_token_bucket(df, rows, limit):
    got = token_bucket(df, ["key"], "ts", "id", 5, 2, 100 * 10**6, limit)
    want = {}
    for group in by_key(rows).values():
        tokens, last = 5, None
        for r in group:
            tick = int((r[2] - datetime(1970, 1, 1)).total_seconds()) // 100
            tokens = min(5, tokens + 2 * (tick - (tick if last is None else last)))
            last = tick
            want[r[0]] = tokens >= 1
            tokens -= tokens >= 1
    assert {r["id"]: r["allowed"] for r in got.collect()} == want


def request(i, seconds, **changes):
    base = dict(
        request_id=f"r{i:03d}", ts=T0 + timedelta(seconds=seconds), organization_id="acme", job_type="sync",
        prompt="p", parameters={"a": "1"}, payload="", timeout_seconds=30, callback_url="",
    )
    return {**base, **changes}


def test_intake_cases(spark):
    """The literal sequence: the duplicate still uses quota."""
    from fleetlens.operators.intake import REQUEST_SCHEMA

    cases = [
        request(0, 0), request(1, 1), request(2, 2, prompt="other"), request(3, 61), request(4, 300),
        request(5, 301, timeout_seconds=None), request(6, 302, organization_id=""),
        request(7, 303, prompt="", payload=""), request(8, 304, job_type=None, organization_id="zeta"),
    ]
    df = spark.createDataFrame(cases, REQUEST_SCHEMA)
    out = {r["request_id"]: r for r in intake(df, SlidingThrottle(2, 100)).collect()}
    assert [out[f"r{i:03d}"]["outcome"] for i in range(5)] == ["accepted", "duplicate", "throttled", "duplicate", "accepted"]
    assert out["r005"]["error"] == "timeout_seconds must be positive"
    assert out["r006"]["error"] == "organization_id is required"
    assert out["r007"]["error"] == "either prompt or payload is required"
    assert out["r008"]["error"] == "job_type is required"
    assert out["r000"]["envelope"].startswith('{"job_id":') and out["r001"]["envelope"] is None


@pytest.mark.parametrize("limit", [10**9, 90])
def test_intake_against_serial_machine(spark, limit):
    from fleetlens.operators.intake import REQUEST_SCHEMA

    rng = random.Random(3)
    cases = [
        request(i, rng.randrange(9000), organization_id=rng.choice(["acme"] * 6 + ["zeta"]), prompt=f"p{rng.randrange(4)}",
                timeout_seconds=rng.choice([30, 30, 30, 0]))
        for i in range(300)
    ]
    df = spark.createDataFrame(cases, REQUEST_SCHEMA)
    got = {r["request_id"]: r["outcome"] for r in intake(df, SlidingThrottle(2, 20), TtlLocks(), limit).collect()}
    machine, states, want = IntakeMachine(SlidingThrottle(2, 20), TtlLocks()), {}, {}
    for c in sorted(cases, key=lambda c: (c["ts"], c["request_id"])):
        state = states.setdefault(c["organization_id"], machine.start())
        us = int((c["ts"] - datetime(1970, 1, 1)).total_seconds()) * 10**6
        want[c["request_id"]] = machine.decide(state, us, None if c["timeout_seconds"] else "bad", c["prompt"])
    assert got == want


def test_more_than_a_thousand_cuts(spark):
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("v"), F.lit("k").alias("k"))
    s = split(df, ["k"], ["v"], 25)
    assert s.segments > 2400
    out = scan(s, {"n": Scan("row_number")}).done()
    assert out.withColumn("want", F.row_number().over(Window.orderBy("v"))).filter("n <> want").count() == 0


@pytest.mark.parametrize("name", ["w6_islands", "w7_probe_state", "w13_positions", "a10_incidents", "a15_sessions", "j11_change_events"])
def test_split_scans_read_the_input_once(spark, name):
    """What is split is written once, and the last scan reads it for its rows and for its carries."""
    df = BUILDS[name](Tables(spark, "/root/testdata/sf0.001", rows_per_task=25))
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan parquet") <= 2


@pytest.mark.parametrize("seed", range(6))
def test_pages_lead_where_rows_lead(seed):
    """A machine's state after pages is the one after the rows, however these are cut and whatever state comes in."""
    import numpy as np

    from fleetlens.operators.intake import LockMachine, ThrottleMachine, TokenBucketMachine

    rng = np.random.default_rng(seed)
    steps = rng.choice([0, 1, 3, 40, 500], 1200, p=[0.2, 0.3, 0.3, 0.15, 0.05])
    times = np.cumsum(steps) + 1000
    machines = [
        ThrottleMachine(SlidingThrottle(5, 30, 60, 900)), ThrottleMachine(SlidingThrottle(90, 100, 200, 150)), LockMachine(70),
        LockMachine(0), TokenBucketMachine(7, 3, 25), TokenBucketMachine(2, 50, 4),
    ]
    cuts = [0, *sorted(rng.choice(np.arange(1, 1200), 9, replace=False).tolist()), 1200]
    for m in machines:
        by_rows, by_pages = m.start(), m.start()
        outputs = []
        for a, b in zip(cuts, cuts[1:]):
            by_rows, out = m.run(by_rows, {"_us": times[a:b]})
            outputs.append(out)
            by_pages = m.carry(m.load(m.dump(by_pages)), m.page({"_us": times[a:b]}))
            assert m.dump(by_rows) == m.dump(by_pages)
        whole = m.run(m.start(), {"_us": times})[1]
        for name, values in whole.items():
            assert np.concatenate([o[name] for o in outputs]).tolist() == values.tolist()


@pytest.mark.parametrize("seed", range(4))
def test_admissions_together_equal_one_by_one(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    times = np.cumsum(rng.choice([0, 1, 2, 90], 6000, p=[0.3, 0.4, 0.295, 0.005])).astype(np.int64)
    for rule in (SlidingThrottle(40, 300, 100, 1500), SlidingThrottle(70, 60, 300, 120), SlidingThrottle(1000, 1000, 200, 4000), SlidingThrottle(0, 5, 50, 60)):
        one, all_ = rule.start(), rule.start()
        want = [rule.admit(one, int(t)) for t in times]
        got = [rule.admit_all(all_, times[a : a + 700]) for a in range(0, len(times), 700)]
        assert np.concatenate(got).tolist() == want
