"""Rows that tell apart the possible readings of a rule."""

import os
import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from compare import TABLES, connect, difference
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.functions.text import quantity
from fleetlens.operators import cluster, metrics, quotas, relations, tracking
from fleetlens.operators.intake import REQUEST_SCHEMA, NoThrottle, TtlLocks, intake
from fleetlens.plans.registry import ORACLES, QUERIES
from fleetlens.sources import files

SF = "/root/testdata/sf0.001"
KEYS = [("email", "e-mail"), ("name", "name")]


def sequential(existing, new):
    """One registration after the other."""
    held, out = [(e, n) for _, e, n in sorted(existing)], {}
    for i, e, n in sorted(new):
        error = None
        for he, hn in held:
            if he == e or hn == n:
                error = "e-mail" if he == e else "name"
                break
        out[i] = error
        if error is None:
            held.append((e, n))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_a_refused_registration_holds_nothing(spark, seed):
    rng = random.Random(seed)
    row = lambda i: (i, f"e{rng.randrange(14)}", f"n{rng.randrange(14)}")
    existing, new = [row(i) for i in range(4)], [row(100 + i) for i in range(40)]
    if seed == 0:
        existing, new = [(1, "e1", "u1"), (2, "e2", "u2")], [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "e2", "u1")]
    schema = "id long, email string, name string"
    out = relations.reject_duplicates(spark.createDataFrame(new, schema), spark.createDataFrame(existing, schema), KEYS, ["id"])
    assert {r["id"]: r["error"] for r in out.collect()} == sequential(existing, new)


def test_tenants_of_like_names_stay_apart(spark, tmp_path):
    rows = [("0012", 1), ("12", 2), ("7", 3), ("a/b=c %", 4)]
    files.write_tenant_partitioned(spark.createDataFrame(rows, "tenant string, n long"), f"{tmp_path}/t", "tenant", ["n"])
    for tenant, n in rows:
        got = files.read_tenant(spark, f"{tmp_path}/t", "tenant", tenant)
        assert [(r["tenant"], r["n"]) for r in got.collect()] == [(tenant, n)]


def test_the_last_change_of_a_key_counts(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, w int")
    changes = spark.createDataFrame([(1, "x", 1, 5), (1, "y", 2, 3), (3, "z", 3, 1), (3, "q", 4, 2)], "k long, v string, w int, seq int")
    assert {tuple(r) for r in relations.upsert(base, changes, "k", ["seq"]).collect()} == {(1, "x", 1), (2, "b", 0), (3, "q", 4)}
    rows, report = relations.update_where(base, changes, "k", "v", ["seq"])
    assert {tuple(r)[:2] for r in rows.collect()} == {(1, "x"), (2, "b")}
    assert {tuple(r) for r in report.collect()} == {(1, True), (3, False)}
    patches = spark.createDataFrame(
        [(1, ["v"], "x", 9, 1), (1, ["w"], "no", 8, 2), (1, ["v"], None, 7, 3), (2, [], "no", 6, 1)],
        "k long, set_fields array<string>, v string, w int, seq int",
    )
    got = relations.patch(base, patches, "k", F.lit(0), order=["seq"]).collect()
    assert {tuple(r) for r in got} == {(1, None, 8), (2, "b", 0)}


def test_a_job_that_vanished_starts_again(spark):
    polls = [(1, 1, 10, "a", "queued", None), (1, 2, 20, "b", "queued", None), (1, 3, 10, "a", "queued", None), (1, 4, 10, "a", "queued", None)]
    df = spark.createDataFrame(polls, "run_id long, poll long, job_id long, name string, status string, conclusion string")
    out = tracking.change_events(df, ["run_id", "job_id"], ["poll"], run=["run_id"])
    assert sorted((r["poll"], r["line"]) for r in out.collect()) == [
        (1, "Job started: a (queued)"), (2, "Job started: b (queued)"), (3, "Job started: a (queued)"),
    ]


def test_two_labels_of_one_name(spark):
    df = spark.createDataFrame([({"meta_a": "1", "meta_b": "2", "x": "3"},)], "labels map<string,string>")
    out = cluster.relabel(df, [{"action": "labelmap", "regex": "meta_.", "replacement": "x"}]).first()
    assert out["labels"] == {"meta_a": "1", "meta_b": "2", "x": "2"}


def test_label_values_survive_writing_and_reading(spark):
    values = ['a"b\\c', "two\nlines", "\\n", 'x",y="z', ""]
    df = spark.createDataFrame([("m", {"l": v, "k": "1"}, 1.0) for v in values], "name string, labels map<string,string>, value double")
    lines = files.to_exposition(df).withColumnRenamed("line", "value")
    assert sorted(r["labels"]["l"] for r in files.ingest_scrapes(lines).collect()) == sorted(values)


def test_broken_scrape_lines_are_told(spark):
    lines = ['m{a="1",a="2"} 3', "m{a=} ", "m 1.5", "# TYPE m counter", "", "m one", "m NaN", 'm{a="1"} 2 1700000000000']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(tuple(r) for r in files.broken_scrapes(df).collect()) == [
        ("m one", "value"), ('m{a="1",a="2"} 3', "repeated label"), ("m{a=} ", "shape"),
    ]
    assert files.ingest_scrapes(df).count() == 3


def test_quantities(spark):
    texts = {"5n": 5e-9, "7u": 7e-6, "1e3": 1e3, "1E": 1e18, "1.5E2": 150.0, "2Ki": 2048.0, ".5": 0.5, "3.": 3.0, "1e3Ki": None, "1.2.3": None, "": None, "e3": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["q"] for r in df.select("t", quantity(F.col("t")).alias("q")).collect()} == pytest.approx(texts)
    use = spark.createDataFrame([("a", "cpu", "1"), ("a", "cpu", "lots")], "namespace string, resource string, amount string")
    hard = spark.createDataFrame([("a", "cpu", "2"), ("b", "cpu", "1")], "namespace string, resource string, hard string")
    assert {tuple(r) for r in quotas.quota_usage(use, hard).select("namespace", "used", "unread").collect()} == {("a", 1.0, 1), ("b", 0.0, 0)}


def rates(samples, range_s, step_s):
    """Rates by looking at every sample of every range."""
    out = {}
    first, last = samples[0][0], samples[-1][0]
    for tick in range(-(-first // step_s) * step_s, last + range_s + step_s, step_s):
        inside = [(t, v) for t, v in samples if tick - range_s < t <= tick]
        if len(inside) < 2:
            continue
        reset = sum(a for (_, a), (_, b) in zip(inside, inside[1:]) if b < a)
        (t0, v0), (t1, v1) = inside[0], inside[-1]
        inc, sampled = v1 - v0 + reset, t1 - t0
        gap = sampled / (len(inside) - 1)
        cut = lambda c: gap / 2 if c >= gap * 1.1 else c
        start = cut(t0 - (tick - range_s))
        if inc > 0 and v0 >= 0:
            start = min(start, sampled * v0 / inc)
        out[tick] = inc * (sampled + start + cut(tick - t1)) / sampled / range_s
    return out


@pytest.mark.parametrize("range_s, step_s", [(300, 2), (3600, 12), (100, 70), (60, 60), (45, 60)])
def test_rates_of_any_range_and_step(spark, range_s, step_s):
    rng = random.Random(range_s)
    t, v, samples = 0, 0.0, []
    for _ in range(120):
        t += rng.choice([5, 7, 15, 40, 400])
        v = rng.choice([0.0, 1.0]) if rng.random() < 0.1 else v + rng.randrange(9)
        samples.append((t, v))
    zero = datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", zero + timedelta(seconds=t), v) for t, v in samples], "series string, ts timestamp_ntz, value double")
    got = metrics.counter_rate(df, ["series"], range_s, step_s).collect()
    base = int((zero - datetime(1970, 1, 1)).total_seconds())
    shifted = rates([(base + t, v) for t, v in samples], range_s, step_s)
    assert {int((r["tick"] - datetime(1970, 1, 1)).total_seconds()): r["rate"] for r in got} == pytest.approx(shifted)


@pytest.mark.parametrize("name", ["t4_correlate_stream", "t5_alert_stream", "t6_counter_stream", "t6_session_stream", "t8_job_state_stream"])
def test_streams_of_another_year(spark, tmp_path, name):
    for table in TABLES:
        os.symlink(f"{SF}/{table}.parquet", f"{tmp_path}/{table}.parquet")
    os.unlink(f"{tmp_path}/events.parquet")
    moved = "SELECT * REPLACE (ts + INTERVAL 400 DAY AS ts) FROM"
    duckdb.sql(f"COPY ({moved} '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    assert difference(QUERIES[name](spark, str(tmp_path)), connect(tmp_path), ORACLES[name]) is None


def test_a_refused_job_releases_its_lock(spark):
    zero = datetime(2024, 1, 1)
    rows = [(f"r{i}", zero + timedelta(seconds=s), "o", "sync", "p", {}, "", 30, "") for i, s in enumerate([0, 10, 20, 30, 400])]
    requests = spark.createDataFrame(rows, REQUEST_SCHEMA)
    refused = spark.createDataFrame([("r0",), ("r2",), ("r4",)], "request_id string")
    got = {r["request_id"]: (r["outcome"], r["envelope"] is None) for r in intake(requests, NoThrottle(), TtlLocks(), refused=refused).collect()}
    assert got == {"r0": ("refused", True), "r1": ("accepted", False), "r2": ("duplicate", True), "r3": ("duplicate", True), "r4": ("refused", True)}
    plain = {r["request_id"]: r["outcome"] for r in intake(requests, NoThrottle(), TtlLocks()).collect()}
    assert plain == {"r0": "accepted", "r1": "duplicate", "r2": "duplicate", "r3": "duplicate", "r4": "accepted"}


def test_queries_run_from_another_folder(tmp_path):
    """Workers get the package from the driver, wherever that was started."""
    code = f"""
import sys; sys.path.insert(0, {str(Path(entry.__file__).parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.entry(spark).count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTEST_CURRENT_TEST")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 1000" in done.stdout, done.stderr[-2000:]


STATEFUL = ["t1_intake_stream", "t3_change_stream", "t5_alert_stream", "t8_job_state_stream"]


def test_streams_with_state_run_from_another_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(Path(entry.__file__).parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
for name in {STATEFUL!r}:
    print(name, __spark_entry__.queries()[name](spark, {SF!r}).count() > 0)
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTEST_CURRENT_TEST")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert [x for x in done.stdout.splitlines() if x.endswith("True")] == [f"{n} True" for n in STATEFUL], done.stderr[-2000:]
