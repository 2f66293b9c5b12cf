import math
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import quality, queries, rules


def test_classifier_query_on_held_out_labels(spark):
    got = queries.op4_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95


def test_scores_are_sparse_dot_products(spark):
    rows = brute.odd_rows()
    weights = np.random.default_rng(1).normal(size=(1 << 12) + 1)
    docs = spark.createDataFrame([(*r, "s") for r in rows], brute.COLUMNS + ", score string")
    got = quality.score(docs, weights).collect()
    features = quality.Features(12)

    def want(text):
        x = np.zeros(1 << 12)
        slots, value = features(text)
        np.add.at(x, slots, value)
        return 1 / (1 + math.exp(-np.clip(weights[:-1] @ x + weights[-1], -35, 35)))

    assert sorted(r.score for r in got) == pytest.approx(sorted(want(r[1]) for r in rows))
    assert len(got) == len(rows)


def test_ftrl_separates_and_averages(spark):
    rows = [(i, ("good fine words here " if i % 2 else "BAD!! JUNK!! TEXT!! ") * (1 + i % 5), i % 2) for i in range(200)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    weights = quality.train(sample, ftrl=quality.Ftrl(bits=14))
    got = quality.score(sample, weights).collect()
    assert all((r.score >= 0.5) == r.label for r in got)
    again = quality.train(sample.repartition(7), ftrl=quality.Ftrl(bits=14))
    assert np.allclose(weights, again)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(brute.odd_rows(), brute.COLUMNS)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    sample = quality.sample_of(docs, labels, "quality", F.lit(True))
    assert {r.score for r in quality.score(docs, quality.train(sample)).collect()} == {0.5}
    assert rules.train(sample) is None
    judged = rules.judge(docs, None).collect()
    assert all(r.kept == (not r.base_failed) and r.quality is None for r in judged)


def test_sample_is_bounded_and_drops_contradictions(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "'t' AS text", "1 AS label")
    rows = [(i, i % 2, 0) for i in range(100)] + [(3, 0, 0), (4, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = quality.sample_of(docs, labels, "quality", F.lit(True)).collect()
    assert len(got) == 99 and {r.doc_id for r in got} == set(range(100)) - {3}
    assert quality.sample_of(docs, labels, "quality", F.lit(True), size=10).count() == 10


def test_rules_query(spark):
    got = queries.op9_quality_rules(spark, brute.SF).collect()
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").toPandas()
    want = {i: brute.quality_counts(t) for i, t in zip(docs.doc_id, docs.text)}
    assert {r.doc_id: tuple(r)[1:6] for r in got} == want and len(got) == len(docs)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_on_odd_rows(spark):
    rows = brute.odd_rows() + [(30, "a b c d e a b c d e a\n\n x \n x \n#|<", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], brute.COLUMNS + ", kept int")
    got = rules.judge(docs, None).collect()
    assert sorted(tuple(r[c] for c in rules.COUNTS) for r in got) == sorted(brute.quality_counts(r[1]) for r in rows)
    assert rules.judge(docs.where("false"), None).count() == 0


def test_rules_keep_labelled_good_documents(spark):
    got = queries.op9_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id")
    held = held[[zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]]
    assert (held.kept == held.quality).mean() > 0.95


def test_trees_are_flat_exact_and_monotone():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * np.sin(5 * x[:, 2]) + rng.normal(size=2000) / 2 > 0).astype(float)
    trees = rules.fit_trees(x, y, np.array([0, -1, 0]))

    def walk(row):
        total = trees.base
        for f, t, a, b, v in zip(trees.feature, trees.threshold, trees.left, trees.right, trees.value):
            at = 0
            while a[at] != at:
                at = a[at] if row[f[at]] <= t[at] else b[at]
            total += v[at]
        return total

    assert trees.score(x[:100]) == pytest.approx([walk(r) for r in x[:100]])
    assert ((trees.score(x) > 0) == y).mean() > 0.8
    free = rules.fit_trees(x, y, np.array([0, 0, 0]))
    steps = np.linspace(-4, 4, 200)
    rising = 0
    for row in x[:60]:
        line = np.tile(row, (200, 1))
        line[:, 1] = steps
        assert (np.diff(trees.score(line)) <= 1e-12).all()
        rising += (np.diff(free.score(line)) > 1e-12).any()
    assert rising  # without the constraint it does rise
