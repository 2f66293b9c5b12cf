import math

import brute
import numpy as np
import pytest

from fleetlens.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n string, w int"


def expected(rows, k=8):
    """{vec_id: deviation}, {(vec_id, component): |whitened|}, explained shares."""
    x = [[math.floor(1024.0 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    d = np.array(x, dtype=np.float64) - np.array(sums) / n
    e, q = np.linalg.eigh(d.T @ d / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return deviation, np.abs(d @ q / np.sqrt(e)), e / np.trace(d.T @ d / n)


def check(got, rows, k):
    deviation, whitened, explained = expected(rows, k)
    want = sorted(
        (i, c + 1, deviation[at], whitened[at, c], explained[c]) for at, (i, _) in enumerate(rows) for c in range(k)
    )
    got = got.sort_values(["vec_id", "component", "deviation"])
    assert list(zip(got.vec_id, got.component, got.deviation)) == [w[:3] for w in want]
    assert set(got.n) == {len(rows)}
    assert np.allclose(np.abs(got.whitened.to_numpy()), [w[3] for w in want], rtol=1e-7, atol=1e-7)
    assert np.allclose(got.explained.to_numpy(), [w[4] for w in want], rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{brute.SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op12_embedding_whitening(spark, brute.SF)
    assert got.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double"),
    ]
    check(got.toPandas(), rows, 8)


def test_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in v]) for i, v in enumerate((rng.normal(size=(60, 5)) * [9, 3, 1, 0.3, 0.1]).astype("float32"))]
    good += [(7, good[3][1]), (3, good[3][1])]  # repeated rows
    bad = [(100, None), (101, []), (102, [None] * 5), (103, [math.nan] * 5), (104, [1.0, math.inf, 0.0, 0.0, 0.0]), (105, [1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], SCHEMA)
    check(whitening.whiten(df, k=4).toPandas(), good, 4)
    ids = spark.createDataFrame([(None, v, "x", 1) for _, v in good] + [(2**53 + 1, good[0][1], "x", 1)], SCHEMA)
    assert {r[0] for r in whitening.whiten(ids, k=4).select("vec_id").collect()} == {None, 2**53 + 1}


def test_too_few_components(spark):
    line = [(i, [float(i), 2.0 * i, 0.0], "x", 1) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(line, SCHEMA)).toPandas()
    assert got.component.tolist() == [1] * 9 and abs(got.explained.iloc[0] - 1) < 1e-12
    same = spark.createDataFrame([(i, [1.0, 2.0], "x", 1) for i in range(5)], SCHEMA)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.where("false")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).count() == 0


def test_exact_whole_numbers_beyond_doubles(spark):
    rows = [(i, [float(2.0**30 * i), float(i % 3)]) for i in range(9)]
    want = expected(rows, 1)[0]
    assert max(want) > 2**63 and min(want) < 2**63
    big = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r.vec_id: r.deviation for r in whitening.whiten(big, k=1).collect()}
    assert got == {i: w if w < 2**63 else None for (i, _), w in zip(rows, want)}


def spectra():
    rng = np.random.default_rng(1)
    for values in (
        rng.uniform(0.9, 1.1, 64), 10.0 ** -np.arange(24), np.ones(20), np.r_[5.0, 5.0, 5.0, np.full(30, 1.0), 0.1, 0, 0],
        np.r_[1e6, 1 + 1e-6 * np.arange(12)], np.r_[np.zeros(9), 3.0], 1.0 / (1 + np.arange(200.0)) ** 2,
        np.r_[np.full(8, 2.0), 2 - 1e-9, np.full(8, 1.0)],
    ):
        q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
        v = q * values @ q.T
        yield np.sort(values)[::-1], (v + v.T) / 2


def test_inertia_counts_eigenvalues():
    for values, v in spectra():
        for shift in np.r_[0.5 * values[1:] + 0.5 * values[:-1], values[0] * 1.1, -1.0][:40]:
            if np.abs(values - shift).min() > 1e-9 * values[0]:
                assert whitening.eigenvalues_above(v, shift) == (values > shift).sum()


@pytest.mark.parametrize("k", [1, 3, 8])
def test_components_are_all_found_and_orthonormal(k):
    for values, v in spectra():
        e, x = whitening.components(v, k)
        n = min(k, int((values > whitening.NOISE * values.sum()).sum()))
        assert len(e) == n and np.allclose(e, values[:n], rtol=1e-9, atol=1e-14 * values[0])
        assert np.allclose(x.T @ x, np.eye(n), atol=1e-13)
        assert np.abs(v @ x - x * e).max() < 1e-12 * values[0]
