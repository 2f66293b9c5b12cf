"""Embedding whitening by contour integration (FEAST).

Exact integer sums give the mean, a second pass the centred covariance; both are sums of a few numbers from each task. The
strongest components are eigenvectors of that covariance, a matrix of the vectors' width that the driver holds. Inertia
counts (signs of the pivots of a symmetric elimination of the shifted covariance) cut the top of its spectrum into
intervals of known contents. For each interval, solves with the covariance shifted to complex points around it, weighted
by a quadrature, project random vectors onto its eigenvectors; Rayleigh-Ritz extracts these, and the counts verify that
none is missed. A third pass projects all rows, and their covariance is measured.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

NODES = 8  # quadrature points of the upper half of a contour
SLICE = 4  # eigenvalues of an interval, if they can be told apart
#: Eigenvalues of less than this share of the trace are rounding noise, not components.
NOISE = 1e-11
LIMIT = 2**62  # whole entries beyond it count as it
LONG = 2**63 - 1


def eigenvalues_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of symmetric ``a`` exceed ``shift``: the positive pivots, with 1x1 and 2x2 ones chosen by size
    (Sylvester's law of inertia)."""
    a = a - shift * np.eye(len(a))
    k = above = 0
    while k < len(a):
        rest = a[k:, k:]
        whole = np.abs(rest)
        own, off = whole.diagonal().copy(), whole
        np.fill_diagonal(off, 0)
        r, at = int(np.argmax(own)), int(np.argmax(off))
        if own[r] == 0 and off.flat[at] == 0:
            break  # zeros are left: eigenvalues equal to the shift
        width = 1 if own[r] >= 0.64 * off.flat[at] else 2
        for to, place in enumerate([r] if width == 1 else sorted(divmod(at, len(rest)))):
            rest[[to, place]] = rest[[place, to]]
            rest[:, [to, place]] = rest[:, [place, to]]
        pivot, side = rest[:width, :width], rest[width:, :width]
        above += int(pivot[0, 0] > 0) if width == 1 else 1  # a 2x2 pivot has one eigenvalue of each sign
        rest[width:, width:] -= side @ np.linalg.solve(pivot, side.T)
        k += width
    return above


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, count) that together hold the k largest eigenvalues above the noise, and few others."""
    trace = float(np.trace(v))
    high = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)  # no eigenvalue is above
    if not high > 0:
        return []
    least, low, over = NOISE * trace, high, high
    n_low = 0
    while n_low < k and low > least:
        over, low = low, max(low / 4, least)
        n_low = eigenvalues_above(v, low)
    for _ in range(60):  # up towards the k-th, to leave out those below
        middle = (low + over) / 2
        if n_low <= k or over - low <= 1e-9 * over:
            break
        n = eigenvalues_above(v, middle)
        low, n_low, over = (middle, n, over) if n >= k else (low, n_low, middle)
    out, todo = [], [(low, high, n_low, 0)]
    while todo:
        a, b, n_a, n_b = todo.pop()
        if n_a == n_b:
            continue
        if (n_a - n_b <= SLICE and b <= 4 * a) or b - a <= 1e-9 * b:
            out.append((a, b, n_a - n_b))
            continue
        middle = float(np.sqrt(a) * np.sqrt(b)) if b > 4 * a else (a + b) / 2
        n = eigenvalues_above(v, middle)
        todo += [(a, middle, n_a, n), (middle, b, n, n_b)]
    return out


def inside(v: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    """The ``count`` eigenvectors whose eigenvalues lie between ``low`` and ``high``, as columns."""
    dim = len(v)
    middle, radius = (low + high) / 2, (high - low) / 2 + 1e-12 * high
    x, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 + x))
    size = min(dim, 2 * count + SLICE)
    edge = 1e-10 * high
    while True:
        y = np.random.default_rng(dim * 1000 + size).normal(size=(dim, size))
        for _ in range(40):
            if size < dim:
                shifted = ((middle + radius * t) * np.eye(dim) - v for t in turn)
                solved = (w / 2 * radius * t * np.linalg.solve(s, y) for w, t, s in zip(weight, turn, shifted))
                y = sum(z.real for z in solved)
            q = np.linalg.qr(y)[0]
            e, small = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz, of the size of the subspace
            y = q @ small
            found = np.flatnonzero((e > low - edge) & (e <= high + edge))
            wrong = np.linalg.norm(v @ y[:, found] - y[:, found] * e[found], axis=0)
            if len(found) >= count and wrong.max(initial=0) <= 4e-14 * np.sqrt(dim) * np.abs(v).max():
                return y[:, found]
            if size == dim:
                return y[:, found]
        size = min(dim, 2 * size)  # the count says that some are missed, or they are too close to their neighbours


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of ``v`` above the noise and their unit eigenvectors as columns; of either sign, the
    entry of greatest size is positive. Raises if the verification fails."""
    parts = [(low, high, count, inside(v, low, high, count)) for low, high, count in intervals(v, k)]
    if not parts:
        return np.empty(0), np.empty((len(v), 0))
    q = np.linalg.qr(np.concatenate([p[3] for p in parts], axis=1))[0]
    e, small = np.linalg.eigh(q.T @ v @ q)
    x = (q @ small)[:, ::-1]
    e, n = e[::-1], sum(p[2] for p in parts)
    low = min(p[0] for p in parts)
    if len(e) < n or eigenvalues_above(v, low) != n or (e[n:] > low * (1 + 1e-9)).any():
        raise ArithmeticError("eigenvalues were missed")
    x, e = x[:, : min(k, n)], e[: min(k, n)]
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return e, x * sign


def _whole(vectors: pd.Series, scale: float, shift: int) -> np.ndarray:
    """floor(scale * entry) + shift as whole numbers, a row for each vector."""
    scaled = np.floor(scale * np.stack(vectors.to_list()).astype(np.float64))
    return np.clip(scaled, -float(LIMIT), float(LIMIT)).astype(np.int64) + shift


@dataclass
class Fit:
    """What the rows of the fit list have in common. ``sums`` are exact."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.sums, self.n)


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S/n with no more error than that of its last rounding: the whole part goes first."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def _summed(rows: DataFrame) -> dict[int, object]:
    return {r[0]: r[1] for r in rows.groupBy("at").agg(F.sum("part")).collect()}


def fit(rows: DataFrame, dim: int, k: int, scale: float, shift: int) -> Fit:
    """Two passes over ``rows`` (v): counts and exact sums, then the covariance; each task gives a few sums of its own."""

    def sums(batches):
        n, total = 0, np.zeros(dim, dtype=object)
        for pdf in batches:
            if len(pdf):
                x = _whole(pdf["v"], scale, shift)
                safe = np.abs(x).max() < 2**62 // len(x)
                n, total = n + len(x), total + (x.sum(axis=0) if safe else x.astype(object).sum(axis=0))
        parts = [Decimal(int(t)) for t in [n, *total]]
        yield pd.DataFrame({"at": np.arange(-1, dim, dtype=np.int32), "part": parts})

    total = _summed(rows.mapInPandas(sums, "at int, part decimal(38,0)"))
    n = int(total.get(-1) or 0)
    s = [int(total.get(i) or 0) for i in range(dim)]
    if not n:
        return Fit(0, s, 0.0, np.empty(0), np.empty((dim, 0)))

    def products(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                d = _centred(_whole(pdf["v"], scale, shift), s, n)
                total += d.T @ d
        yield pd.DataFrame({"at": np.arange(dim * dim, dtype=np.int32), "part": total.ravel()})

    found = _summed(rows.mapInPandas(products, "at int, part double"))
    v = np.array([found[i] for i in range(dim * dim)]).reshape(dim, dim) / n
    v = (v + v.T) / 2
    return Fit(n, s, float(np.trace(v)), *components(v, k))


def _deviation(x: np.ndarray, fitted: Fit) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where it exceeds 64 bits."""
    s = np.array(fitted.sums, dtype=object)
    if fitted.n * int(np.abs(x).max()) < 2**62 and max(map(abs, fitted.sums)) < 2**62:
        d = fitted.n * x - s.astype(np.int64)
        if float(np.abs(d).max()) ** 2 * x.shape[1] < 2**62:
            return (d * d).sum(axis=1).tolist()
    exact = ((fitted.n * x.astype(object) - s) ** 2).sum(axis=1)
    return [e if e <= LONG else None for e in exact]


def whiten(
    vectors: DataFrame, k: int = 8, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0,
    shift: int = 100_000,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component up to k.

    Entries become whole numbers x = floor(scale * entry) + shift. Vectors that are null, empty or hold null, NaN or
    infinity take no part, nor do those of another length than the most common one (the smaller, if two are). Components
    of less than NOISE of the trace are no components: equal vectors have none and give no rows, and few distinct ones
    give few. Repeated rows count each; null ids stay. Entries beyond 2^62 count as 2^62; ``deviation`` is null beyond 64
    bits. Other columns of ``vectors`` are not read."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("vec_id"), v.alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite)
    )
    id_type = vectors.schema[key].dataType.simpleString()
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = int(sizes["dim"]) if sizes else 1
    rows = rows.where(F.size("v") == dim)
    fitted = fit(rows.select("v"), dim, k, scale, shift)
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)

    def project(batches):
        f = shared.value
        for batch in batches:
            pdf = batch.select(["v"]).to_pandas()
            if not len(pdf):
                continue
            x = _whole(pdf["v"], scale, shift)
            w = f.centred(x) @ f.vectors / np.sqrt(f.values)
            w = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(_deviation(x, f), pa.int64()), w], ["vec_id", "deviation", "w"]
            )

    found = len(fitted.values)
    rows = rows if found else rows.where("false")
    out = stored(rows.mapInArrow(project, f"vec_id {id_type}, deviation long, w array<double>"))
    error = None
    if found:
        pairs = [(i, j) for i in range(found) for j in range(i + 1)]
        measured = out.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
        error = max(abs(m - (i == j)) for (i, j), m in zip(pairs, measured))
    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values]).cast("array<double>")
    return out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
