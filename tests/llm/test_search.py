import math

import brute
import numpy as np
from compare import connect, difference
from pyspark.sql import functions as F

from fleetlens.llm import queries
from fleetlens.llm.registry import ORACLES
from fleetlens.llm.search import Hits, Side, survivors, top_k

SCHEMA = "vec_id long, embedding array<float>, score long"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_query(spark):
    assert difference(queries.op1_exact_top_k(spark, brute.SF), connect(brute.SF), ORACLES["op1_exact_top_k"]) is None


def test_many_chunks_groups_and_ties(spark):
    rng = np.random.default_rng(5)
    drawn = (rng.normal(size=(400, 12)) * 10.0 ** rng.integers(-2, 2, size=(400, 1))).astype("float32")
    vectors = [(i, [float(x) for x in v], 1) for i, v in enumerate(drawn)]
    vectors += [(1000 + i, vectors[7][1], 1) for i in range(150)]  # a group of copies
    df = spark.createDataFrame(vectors, SCHEMA)
    got = rows_of(top_k(df, F.col("vec_id") % 5 == 0, seed=16, chunk=32, group=8))
    assert got == brute.top_k([v[:2] for v in vectors], lambda i: i % 5 == 0)


def test_unusable_vectors_take_no_part(spark):
    vectors = [
        (0, [1.0, 2.0], 1), (1, None, 1), (2, [], 1), (3, [None, 1.0], 1), (4, [math.nan, 1.0], 1),
        (5, [math.inf, 0.0], 1), (6, [0.5, 0.5], 1), (6, [0.5, 0.5], 1), (None, [1.0, 1.0], 1), (8, [0.0, 0.0], 1),
        (10, [-1.0, -2.0], 1),
    ]
    got = rows_of(top_k(spark.createDataFrame(vectors, SCHEMA), F.col("vec_id") % 2 == 0))
    good = [(0, [1.0, 2.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (8, [0.0, 0.0]), (10, [-1.0, -2.0])]
    assert got == brute.top_k(good, lambda i: True)


def test_repeated_ids_and_clashing_columns(spark):
    """Every row is a candidate and, by its id, a query: also eight unlike vectors of one id, and a copy of the query."""
    rng = np.random.default_rng(8)
    drawn = lambda i, n: [(i, [float(x) for x in v]) for v in rng.normal(size=(n, 6)).astype("float32")]
    rows = drawn(1, 1) + drawn(2, 8) + [r for i in range(10, 16) for r in drawn(i, 1)]
    rows += [rows[0], rows[2], rows[2]]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<float>, row string, query_id int, norm double")
    c = F.col("vec_id")
    for condition, is_query in ((c == 1, lambda i: i == 1), (c == 2, lambda i: i == 2), (c % 2 == 0, lambda i: i % 2 == 0)):
        assert rows_of(top_k(df, condition, seed=4, chunk=3, group=2)) == brute.top_k(rows, is_query)


def test_pruning_on_vectors_of_one_length():
    """Pairs with any component summed, and pairs left for exact scores, where length rules out nothing."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 64))
    v = centres[rng.integers(0, 40, 4000)] + 0.35 * rng.normal(size=(4000, 64))
    ints = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True))
    turn = np.linalg.eigh(ints.T @ ints)[1][:, ::-1].copy()
    side = Side(np.arange(4000), np.arange(4000), ints, turn)
    q = Side(np.arange(80), np.arange(80), ints[:80], turn)
    all_scores = (ints[:80] @ ints.T).astype(np.int64)
    np.fill_diagonal(all_scores, -(2**62))
    fifth = np.sort(all_scores, axis=1)[:, -5]
    i, j, summed = survivors(q, side, np.arange(80), np.arange(4000), fifth.astype(float))
    assert len(i) < 0.01 * 80 * 4000 and summed < 4 * 80 * 4000  # of four steps' sums
    assert set(zip(*np.nonzero(all_scores >= fifth[:, None]))) <= set(zip(i.tolist(), j.tolist()))
    hits = Hits(q, np.full(80, -np.inf), 5)
    hits.search(side, 256)
    assert sorted(zip(hits.found[0].tolist(), hits.found[1].tolist())) == sorted(
        (r, s) for r in range(80) for s in np.sort(all_scores[r])[-5:].tolist()
    )


def test_scores_beyond_doubles_are_exact(spark):
    vectors = [(i, [2.0**21 + i, 3.0, -(2.0**20) - 3 * i], 1) for i in range(6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score long")
    got = rows_of(top_k(df, F.col("vec_id") % 2 == 0))
    assert got == brute.top_k([v[:2] for v in vectors], lambda i: i % 2 == 0)
    assert min(r[3] for r in got) > 2**53


def test_scores_beyond_64_bits_saturate(spark):
    vectors = [(i, [2.0**40 + i, 3.0, 2.0**41], 1) for i in range(6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score long")
    assert rows_of(top_k(df, F.col("vec_id") == 0)) == [(0, n, n, 2**63 - 1) for n in range(1, 6)]


def test_empty(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).count() == 0
    assert top_k(spark.createDataFrame([(1, [1.0], 1)], SCHEMA), F.col("vec_id") % 2 == 0).count() == 0
