"""Exact top-k search by inner product over norm-sorted, rotated vectors.

Vectors are rotated by the right singular vectors of all of them, so that leading components carry most of a product. A
bounded set of vectors, the longest and a spread sample, gives every query a first threshold: its k-th best score there.
Each task then takes its vectors by descending length. By Cauchy and Schwarz a query needs no vector shorter than
``threshold / |query|``, so what remains is left out as soon as no query needs it. For the others, partial sums over more
and more leading components, as matrix products, plus the product of the residual lengths bound the scores from above;
after every step queries and vectors without a pair that may reach its threshold are dropped. What is left is scored
exactly, in integers. Where vectors are of one length and no direction is stronger than others, few pairs go before most
components are summed, and the work grows with queries times vectors, a few nanoseconds for each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import new_path, stored

SEED = 2048  # vectors that set the first thresholds
CHUNK = 1024  # vectors looked at together
QUERIES = 4096  # queries looked at together
GROUP_NUMBERS = 2**22  # components of the queries that every task holds at a time
STEPS = (0.25, 0.5, 0.75, 0.875)  # shares of the components in the partial sums
FEW = 0.02  # share of pairs from which on they are scored as a matrix


def _matrix(values: pd.Series, dim: int) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64).reshape(len(values), dim)


def usable(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """row, vec_id and ``ints``, the floored components as doubles; rows that are null or hold null, NaN or infinity go.

    A vector without components goes too, and so does a row without an id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vector).cast("array<double>")
    return (
        vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
        .select("row", "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("ints"))
    )


def rotation(ints: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, strongest first, from the sum of outer products (dim x dim numbers)."""

    def gram(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            m = _matrix(pdf["ints"], dim)
            total += m.T @ m
        yield pd.DataFrame({"at": np.arange(dim * dim), "part": total.ravel()})

    parts = ints.select("ints").mapInPandas(gram, "at int, part double")
    sums = parts.groupBy("at").agg(F.sum("part").alias("total")).toPandas()
    total = np.zeros(dim * dim)
    total[sums["at"].to_numpy()] = sums["total"].to_numpy()
    return np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1].copy()


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of row pairs as whole numbers; those beyond 64 bits become the nearest of 64 bits."""
    bound = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[-1]
    if bound < 2**52:
        return (q * v).sum(axis=-1).astype(np.int64)
    whole = lambda a: np.array([int(x) for x in a.ravel()], dtype=object).reshape(a.shape)
    top, low = 2**63 - 1, -(2**63)
    return np.array([min(max(x, low), top) for x in (whole(q) * whole(v)).sum(axis=-1)], dtype=np.int64)


def best(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, highest score first, ties to the smaller id."""
    order = np.lexsort((vec_id, ~score, query))
    q = query[order]
    first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def _below(score: np.ndarray) -> np.ndarray:
    """A double that is surely no more than the score."""
    return np.nextafter(score.astype(np.float64), -np.inf)


class Side:
    """Vectors of one side of a product: exact, rotated, and the lengths of what follows each step's components."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, ints: np.ndarray, turn: np.ndarray):
        self.rows, self.ids, self.ints = rows, ids, ints
        self.norm = np.sqrt((ints * ints).sum(axis=1))
        self.turned = ints @ turn
        self.cuts = sorted({0, *(int(s * len(turn)) for s in STEPS)})
        squares = self.turned**2
        self.rest = [np.sqrt(squares[:, c:].sum(axis=1)) for c in self.cuts]

    def __len__(self) -> int:
        return len(self.rows)


def survivors(q: Side, v: Side, qs: np.ndarray, vs: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of ``qs`` and ``vs`` whose bounds reach the queries' needs after every step, and how many a step summed."""
    part, summed = np.zeros((len(qs), len(vs))), 0
    slack = 1e-9 * q.norm[qs, None] * v.norm[vs].max(initial=0) + 1e-6
    floor = need[qs, None] - slack
    for step in range(1, len(q.cuts)):
        a, b = q.cuts[step - 1], q.cuts[step]
        part += q.turned[qs, a:b] @ v.turned[vs, a:b].T
        summed += part.size
        live = part + np.outer(q.rest[step][qs], v.rest[step][vs]) >= floor
        rows, columns = live.any(axis=1), live.any(axis=0)
        if not rows.any():
            return qs[:0], vs[:0], summed
        if rows.sum() < 0.8 * len(rows) or columns.sum() < 0.8 * len(columns):
            qs, vs, floor = qs[rows], vs[columns], floor[rows]
            part, live = part[np.ix_(rows, columns)], live[np.ix_(rows, columns)]
    i, j = np.nonzero(live) if len(q.cuts) > 1 else np.indices(part.shape).reshape(2, -1)
    return qs[i], vs[j], summed


def scores(q: Side, v: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of pairs: a matrix product where pairs are many and doubles hold it exactly, else pair by pair."""
    qs, a = np.unique(i, return_inverse=True)
    vs, b = np.unique(j, return_inverse=True)
    left, right = q.ints[qs], v.ints[vs]
    bound = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * left.shape[-1]
    if bound < 2**52 and len(i) >= FEW * len(qs) * len(vs):
        return (left @ right.T)[a, b].astype(np.int64)
    dim = max(1, left.shape[-1])
    parts = np.array_split(np.arange(len(i)), max(1, len(i) * dim // 4_000_000))
    return np.concatenate([exact(left[a[p]], right[b[p]]) for p in parts])


class Hits:
    """The k best of each query so far, and the least score that may still enter."""

    def __init__(self, q: Side, need: np.ndarray, k: int):
        self.q, self.need, self.k = q, need.astype(np.float64).copy(), k
        self.found = [np.empty(0, np.int64)] * 4  # query's place, score, vec_id, row

    def search(self, v: Side, chunk: int, at_once: int = QUERIES) -> int:
        """Take vectors ``v``, longest first. Returns the number of pairs with any component summed."""
        order, summed = np.argsort(-v.norm, kind="stable"), 0
        for at in range(0, len(order), chunk):
            vs = order[at : at + chunk]
            longest = v.norm[vs[0]]
            live = np.flatnonzero(self.q.norm * longest * (1 + 1e-9) + 1e-6 >= self.need)
            if not len(live):
                break  # every later vector is shorter
            for part in range(0, len(live), at_once):
                i, j, n = survivors(self.q, v, live[part : part + at_once], vs, self.need)
                summed += n
                own = self.q.rows[i] == v.rows[j]
                i, j = i[~own], j[~own]
                if len(i):
                    self._enter(i, scores(self.q, v, i, j), v.ids[j], v.rows[j])
        return summed

    def _enter(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        enough = score >= self.need[i]
        new = [a[enough] for a in (i, score, ids, rows)]
        i, score, ids, rows = (np.concatenate(x) for x in zip(self.found, new))
        keep = best(i, score, ids, self.k)
        self.found = [a[keep] for a in (i, score, ids, rows)]
        place, counts = np.unique(self.found[0], return_counts=True)
        full = counts == self.k  # these have k scores of their own: the last of them is a threshold
        last = (np.cumsum(counts) - 1)[full]
        self.need[place[full]] = np.maximum(self.need[place[full]], _below(self.found[1][last]))


_HITS = "query_row long, query_id long, vec_id long, score long"


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
    seed: int = SEED, chunk: int = CHUNK, group: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query with all other rows.

    ``queries`` is a condition on ``vec_id``; ties go to the smaller id. Every usable row is a candidate for every other
    one, and every row that meets the condition is a query of its own, also where ids or whole rows repeat. Vectors of
    another length than the most common one of the table (the smaller, if two are) take no part, nor do unusable ones.
    Scores beyond 64 bits count as the nearest 64-bit number. Other columns of ``vectors`` are not read.

    Queries go in groups of a bounded size (``group`` rows), one job for each; a job reads all vectors once."""
    spark = vectors.sparkSession
    ints = usable(vectors, key, vector, scale)
    # a row's number is written down once, as it is no fact of the table
    ints = stored(ints.withColumn("norm", F.sqrt(F.aggregate("ints", F.lit(0.0), lambda a, x: a + x * x))))
    sizes = ints.groupBy(F.size("ints").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = int(sizes["dim"])
    ints = ints.where(F.size("ints") == dim)
    turn = rotation(ints, dim)
    longest = ints.orderBy(F.desc("norm"), "row").limit(seed - seed // 2)
    spread = ints.orderBy(F.xxhash64("row"), "row").limit(seed // 2)
    seeds = longest.unionAll(spread).select("row", "vec_id", "ints").toPandas().drop_duplicates("row")
    shared = spark.sparkContext.broadcast((seeds, turn))
    side = lambda pdf, turn: Side(pdf["row"].to_numpy(), pdf["vec_id"].to_numpy(), _matrix(pdf["ints"], dim), turn)

    def first(batches):
        seeds, turn = shared.value
        for pdf in batches:
            if len(pdf):
                hits = Hits(side(pdf, turn), np.full(len(pdf), -np.inf), k)
                hits.search(side(seeds, turn), chunk)
                yield pdf.assign(threshold=hits.need)

    asked = ints.where(queries).select("row", "vec_id", "ints")
    asked = stored(asked.mapInPandas(first, "row long, vec_id long, ints array<double>, threshold double"))
    groups = max(1, -(-asked.count() // (group or max(1, GROUP_NUMBERS // dim))))
    found = new_path(spark)
    for g in range(groups):
        mine = asked.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).toPandas()
        sent = spark.sparkContext.broadcast((mine, turn))

        def search(batches, sent=sent):
            mine, turn = sent.value
            q = side(mine, turn)
            hits = Hits(q, mine["threshold"].to_numpy(), k)
            for pdf in batches:
                if len(pdf):
                    hits.search(side(pdf, turn), chunk)
            i, score, ids, _ = hits.found
            yield pd.DataFrame({"query_row": q.rows[i], "query_id": q.ids[i], "vec_id": ids, "score": score})

        by_length = ints.select("row", "vec_id", "ints", "norm").sortWithinPartitions(F.desc("norm")).drop("norm")
        by_length.mapInPandas(search, _HITS).write.mode("append").parquet(found)
        sent.destroy()
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    hits = spark.read.schema(_HITS).parquet(found).withColumn("rank", F.row_number().over(order))
    return hits.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
