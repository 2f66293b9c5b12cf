import brute
import numpy as np

from fleetlens.llm import queries, simhash
from fleetlens.llm.components import components


def test_query(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").toPandas()
    prints = [(i, brute.fingerprint(t)) for i, t in zip(docs.doc_id, docs.text)]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute.components(prints)))
    got = queries.op8_simhash_near_dedup(spark, brute.SF).collect()
    assert sorted(tuple(r) for r in got) == want


def test_odd_rows(spark):
    rows = brute.odd_rows() + [(20, "one"), (21, "two words"), (22, "Two WORDS")]
    rows = [(r[0], r[1], 1, "x") for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    prints = [(r[0], brute.fingerprint(r[1])) for r in rows]
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    want = sorted(str((i, signed(f), c)) for (i, f), c in zip(prints, brute.components(prints)))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def near(values, bits):
    return {(i, j) for j in range(len(values)) for i in range(j) if bin(int(values[i] ^ values[j])).count("1") <= bits}


def sample(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**64, n // 6, dtype=np.uint64)
    x = [int(c) for c in centres]
    for _ in range(n - len(x)):
        flips = rng.choice(64, rng.integers(0, 4), replace=False)
        x.append(int(rng.choice(centres)) ^ sum(1 << int(b) for b in flips))
    return np.unique(np.array(x, dtype=np.uint64))


def test_near_fingerprints_share_a_key_and_are_found():
    x = sample(600)
    want = near(x, 2)
    k = simhash.keys(x)
    assert all((k[i] == k[j]).any() for i, j in want)
    i, j = simhash.near_pairs(x)
    assert set(zip(i.tolist(), j.tolist())) == want


def test_probing_finds_the_same_pairs(monkeypatch):
    x = sample(500)
    monkeypatch.setattr(simhash, "ALL_PAIRS", 10)
    i, j = simhash.near_pairs(x)
    assert set(zip(i.tolist(), j.tolist())) == near(x, 2)


def test_components_of_chains_stars_and_pairs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200), (7, 7), (200, 300)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
