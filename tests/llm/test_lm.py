import math
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import lm, queries
from fleetlens.llm.common import remainder


def counts(rows, order):
    out = [Counter() for _ in range(order)]
    for text in rows:
        w = [*brute.words(text), None]
        padded = [0] * (order - 1) + w
        for n in range(order):
            out[n].update(tuple(padded[i + order - 1 - n : i + order]) for i in range(len(w)))
    return out


def expected(text, grams, weights, order):
    n_tokens, n_types = sum(grams[0].values()), len(grams[0])
    w = [*brute.words(text), None]
    padded, score, base = [0] * (order - 1) + w, 0.0, 0.0
    for i in range(len(w)):
        gram = tuple(padded[i : i + order])
        context, p = n_tokens, [1 / (n_types + 1)]
        for n in range(order):
            own = gram[order - 1 - n :]
            if n:
                context = grams[n - 1][own[:-1]] if i else grams[0][(None,)]
            p.append(grams[n][own] / context if context else 0.0)
        level = min(int(math.log2(context)) + 1, lm.LEVELS - 1) if context else 0
        score += math.log10(sum(a * b for a, b in zip(weights[level], p)))
        base += math.log10((grams[0][gram[-1:]] + 0.1) / (n_tokens + 0.1 * (n_types + 1)))
    return len(w), sum(grams[0][(x,)] > 0 for x in w), n_tokens, base, score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_follow_the_formula(spark, monkeypatch, order):
    rows = [(r[0], r[1]) for r in brute.odd_rows()]
    rows += [(100 + i, " ".join(f"w{(i * k) % 17}" for k in range(1, 30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = {}
    learn = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a, **k: seen.setdefault("w", learn(*a, **k)))
    got = lm.score(docs, F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 1, order=order).collect()
    grams = counts([t for i, t in rows if i is not None and i % 3], order)
    want = sorted(((i is None, i, *expected(t, grams, seen["w"], order)) for i, t in rows), key=str)
    have = sorted(((r[0] is None, *r) for r in got), key=str)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert [w[5:] for w in want] == [pytest.approx(h[5:]) for h in have]
    assert all(abs(sum(w) - 1) < 1e-9 for w in seen["w"])


def test_weights_by_expectation_maximisation_raise_the_likelihood():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    cells = pd.DataFrame({"level": 3, "count": rng.integers(1, 9, 50), "p0": 1e-3, "p1": rng.random(50) / 50, "p2": rng.random(50)})
    p = cells[["p0", "p1", "p2"]].to_numpy()
    fit = lambda w: (cells["count"] * np.log(p @ w)).sum()
    found = [fit(lm.learn(cells, 2, rounds)[3]) for rounds in (1, 3, 30)]
    assert found == sorted(found)
    assert found[-1] > max(fit(rng.dirichlet([1, 1, 1])) for _ in range(200)) - 1e-3


def test_query_beats_its_base_on_held_out_texts(spark):
    got = queries.op2_lm_scoring(spark, brute.SF).toPandas()
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 10 == 0 for i in got.doc_id]).all()
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()
    grams = counts([t for i, t in zip(docs.doc_id, docs.text) if zlib.crc32(str(i).encode()) % 10], 1)
    text = dict(zip(docs.doc_id, docs.text))
    for r in got.itertuples():
        want = expected(text[r.doc_id], grams, [[1, 0]] * lm.LEVELS, 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3])


def test_empty_table_and_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, score int")
    assert lm.score(empty, F.lit(True), F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.score(one, remainder(F.col("doc_id"), 10) > 99, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == pytest.approx(0.0) and math.isfinite(row.score)
