import hashlib
import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import periods, queries


def runs_of(words, least=24, times=3):
    """Every period tried at every place; a stretch counts under its smallest period only."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def cycled(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = cycled(doc_id, brute.WORD.findall(text or ""))
    runs = runs_of(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = (None,) * 4
    for s, m, q in runs:
        if best[0] is None or m * best[2] > best[1] * q:
            best = (s, m, q, 1000 * m // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").toPandas()
    want = sorted(expected(i, t) for i, t in zip(docs.doc_id.tolist(), docs.text))
    got = queries.op11_periodic_runs(spark, brute.SF)
    assert sorted(tuple(r) for r in got.select(*NAMES).collect()) == want
    assert sum(r[1] > 0 for r in want) > 5
    assert dict(got.dtypes) == dict.fromkeys(NAMES, "bigint") | {"runs_sha256": "string", "collapsed_sha256": "string"}


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(300):
        words = []
        while len(words) < rng.randint(0, 160):
            block = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 20))]
            words += block * rng.randint(1, 9) + block[: rng.randint(0, len(block))]
        least, times = rng.choice([(24, 3), (6, 3), (12, 4)])
        got = periods.find_runs(words, least, times)
        assert [tuple(r) for r in got.tolist()] == runs_of(words, least, times), words


def test_nested_and_long_periods():
    inner = [b"a", b"b"] * 15 + [b"c"]
    for words in (inner * 4, inner * 3, (inner * 4)[:-1], [b"x"] * 500, [b"%d" % (i % 700) for i in range(2100)]):
        assert [tuple(r) for r in periods.find_runs(words).tolist()] == runs_of(words)
    assert periods.find_runs([b"%d" % (i % 700) for i in range(2099)]).tolist() == []


def test_odd_rows_and_clashing_columns(spark):
    rows = [(r[0], r[1], "x", 1) for r in brute.odd_rows()] + [
        (50, "a\u00a0b \u2003" * 40, "x", 1), (51, "\x0b go\x0cgo\r" * 30, "x", 1), (None, "la " * 99 + "lo", "x", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = periods.periodic_runs(docs).select("doc_id", "n_words", "runs", "collapsed").collect()
    want = []
    for doc_id, text, *_ in rows:
        words = brute.WORD.findall(text or "")
        runs = runs_of(words) if len(words) < 9000 else [(0, 40000, 10)]
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        want.append((doc_id, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert sorted(str((r[0], r[1], [tuple(x) for x in r[2]], r[3])) for r in got) == sorted(map(str, want))
    assert periods.periodic_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, least_periods=2)


def test_cycles_of_the_contract(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:30] + [None, 3]
    rows = [(i, " ".join(f"w{j}" for j in range(k))) for k, i in enumerate(ids)] + [(ids[5], " \n"), (ids[6], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("doc_id", queries.cycled(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert [brute.WORD.findall(t or "") for _, t in got] == [cycled(i, brute.WORD.findall(t or "")) for i, t in rows]
