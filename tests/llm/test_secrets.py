import hashlib
import re

import brute
from compare import connect, difference
from pyspark.sql import functions as F

from fleetlens.llm import queries, secrets
from fleetlens.llm.registry import ORACLES

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
COLUMNS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def base(text):
    """(start, kind number, end) of the contract's plain rule."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def random(value):
    return (len(re.findall("[0-9]", value)) >= 3 and len(re.findall("[A-Za-z]", value)) >= 3 and len(set(value)) >= 10)


def brute_force(rows):
    """rows: (doc_id, text, owner)."""
    holders, spans = {}, []
    for doc_id, text, owner in rows:
        text = text or ""
        tokens = [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+_=-]{20,}", text) if random(m[0])]
        mine = base(text) + tokens
        values = [ASSIGN.match(text, s)[2] if k == 0 else text[s:e] for s, k, e in mine]
        for v in values:
            holders.setdefault(v, set()).add(owner)
        spans.append((doc_id, list(zip(mine, values))))
    out = []
    for doc_id, mine in spans:
        kept = [x for x, _ in mine if x[1] < 3]
        added = [x for x, v in mine if x[1] == 3 and len(holders[v]) == 1
                 and not any(s < x[2] and x[0] < e for s, _, e in kept)]
        named = lambda a: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(a))
        counts = [sum(k == i for _, k, _ in kept) for i in range(3)]
        out.append((doc_id, *counts, hashlib.sha256(named(kept).encode()).hexdigest(), named(kept + added)))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, o, "x", 1) for i, t, o in rows], "doc_id long, text string, source string, row string, hash int")
    got = secrets.report(*secrets.scan(docs, F.col("source"), F.col("row")))
    return sorted((tuple(r) for r in got.select("doc_id", *COLUMNS).collect()), key=str)


def test_query(spark):
    sql = ORACLES["op13_secret_scan"]
    assert difference(queries.op13_secret_scan(spark, brute.SF), connect(brute.SF), sql) is None


def test_patterns_overlaps_and_code_points(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = [
        (1, f"é😀 password = 'hunter2hunter2' {key}x", "a"), (2, "Token:abc123abc123abc123abc123", "a"),
        (3, "token: secret: abcdefghijklmnop API_KEY==aaaaaaaaaaaa", "a"),  # a failing match still takes its signs
        (4, "password=short passwd\"  :  \"longenough-value-1", "b"), (5, "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", "b"),
        (6, "0123456789abcde 0123456789abcdef 0123456789abcdefg", "c"), (7, "AKIA1234567890123 AKIAAKIA1234567890", "c"),
        (8, "xx-Zk39fQm20vLpA7-secret=Qw12Er34Ty56Ui78 alone Zk39fQm20vLpA7RtUv55", "c"),
        (9, "shared Zk39fQm20vLpA7RtUv66 and own Mm39fQm20vLpA7RtUv77", "a"), (10, "again Zk39fQm20vLpA7RtUv66", "b"),
        (11, "\x00\x01 secret\n=abcdefghijklmnop secret =\tabcdefghijklmnop", "b"),
        (12, "a" * 100 + " " + "well-known-long-names-without-digits " * 3, "c"),
    ]
    got = run(spark, rows)
    assert got == brute_force(rows)
    spans = {r[0]: r[-1] for r in got}
    assert "token:" in spans[9] and spans[10] == "" and spans[9].count("token:") == 1 and "token" in spans[8]


def test_odd_rows(spark):
    many = " ".join(f"{i:016x} token=value-number-{i:06d}" for i in range(3000))  # a long text full of them
    rows = [(r[0], r[1], r[3]) for r in brute.odd_rows()] + [
        (30, many, "a"), (31, "secret=abcdefghijkl", None), (31, "secret=abcdefghijkl", None), (None, "AKIA" + "Z" * 30, "b"),
    ]
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, []) == []


def test_examples_and_live_credentials_part_by_owners(spark):
    # one value in a third of all rows: hot, and copied by many owners
    rows = [(i, "password=Example1234Example", f"o{i % 7}") for i in range(700)]
    rows += [(1000 + i, f"secret=Zq{i:06d}Lm48Ks92", f"o{i % 7}") for i in range(1400)]
    rows += [(5000 + i, "secret=Own12345Abcdef99", "o3") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, spans = secrets.scan(docs, F.col("source"), F.col("doc_id"))
    got = {
        r["verdict"]: (r["n"], r["owners"], r["repositories"])
        for r in spans.groupBy("verdict").agg(F.count("*").alias("n"), F.max("owners").alias("owners"), F.max("repositories").alias("repositories")).collect()
    }
    assert got == {"example": (700, 7, 700), "live": (1405, 1, 5)}
    assert documents.count() == len(rows)


def test_native(spark):
    plan = queries.op13_secret_scan(spark, brute.SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
