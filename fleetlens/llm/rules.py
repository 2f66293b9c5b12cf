"""Quality rules: gradient-boosted trees over document statistics.

Base counts and ratios are computed per document. A model of histogram-split trees is fitted on a bounded labelled sample,
with monotonic constraints on chosen statistics, and flattened into numpy node arrays, through which all documents of a
batch descend together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (
    "log_words", "mean_word", "symbols", "dup_lines", "repeat_words", "distinct", "upper", "digits", "marks",
)
#: -1: a higher value never raises the score. Junk by these signs stays junk when it has more of them.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1}


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside a window of ``width`` words that occurs twice or more in the text, the first time included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == len(words):
        return 0
    names, size = ids, len(number)
    for k in range(1, width):  # exact: equal windows, and only they, get one number
        names, size = names[:-1] * len(number) + ids[k:], 0
        if k < width - 1:
            names = np.unique(names, return_inverse=True)[1]
    _, names, counts = np.unique(names, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[names] > 1)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return int((np.cumsum(marks) > 0).sum())


def base_counts(text: str | None) -> tuple[list[int], list[float]]:
    """The five counts and the statistics of a text; a null text counts as empty."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    again = repeat_words(words)
    folded = text.encode()
    upper = len(folded) - len(folded.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(folded) - len(folded.translate(None, b"0123456789"))
    marks = len(folded) - len(folded.translate(None, b"!?.,;:"))
    w, c = max(n, 1), max(chars, 1)
    stats = [
        np.log1p(n), chars / w, symbols / w, dup / max(len(lines), 1), again / w, len(set(words)) / w, upper / c,
        digits / c, marks / w,
    ]
    return [n, chars, symbols, dup, again], stats


@dataclass
class Trees:
    """Node arrays of all trees, one row for each tree. A leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``; all rows go down a tree together."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, a, b, v in zip(self.feature, self.threshold, self.left, self.right, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, f[at]] <= t[at], a[at], b[at])
            out += v[at]
        return out


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2,
    bins: int = 64, l2: float = 1.0, least: float = 2.0,
) -> Trees:
    """Boosting with logistic loss. ``monotone``: -1, 0 or 1 for each column.

    A split on a constrained column must order its children's values, and their mid-point bounds every value below, so
    the constraint holds for whole trees and so for their sum."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    raw = np.full(n, base := float(np.log(p / (1 - p))))
    size, trees = 2 ** (depth + 1), []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    for _ in range(n_trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        feature, threshold = np.zeros(size, dtype=np.int64), np.zeros(size)
        left, right, value, used = np.arange(size), np.arange(size), np.zeros(size), 1
        todo = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * leaf(gs, hs, low, high)
            raw_gain, best = 1e-6, None
            for j in range(m) if level < depth else ():
                width = len(cuts[j]) + 1
                gl = np.cumsum(np.bincount(code[rows, j], g[rows], width))[:-1]
                hl = np.cumsum(np.bincount(code[rows, j], h[rows], width))[:-1]
                a = np.clip(-gl / (hl + l2), low, high)
                b = np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                own = leaf(gs, hs, low, high)
                drop = lambda v, gg, hh: -(gg * v + 0.5 * (hh + l2) * v * v)
                gain = drop(a, gl, hl) + drop(b, gs - gl, hs - hl) - drop(own, gs, hs)
                gain[(hl < least) | (hs - hl < least) | (monotone[j] * (b - a) < 0)] = -np.inf
                if len(gain) and gain.max() > raw_gain:
                    k = int(np.argmax(gain))
                    raw_gain, best = gain[k], (j, k, a[k], b[k])
            if best is None:
                raw[rows] += value[node]
                continue
            j, k, a, b = best
            feature[node], threshold[node], left[node], right[node] = j, cuts[j][k], used, used + 1
            mid, goes = (a + b) / 2, code[rows, j] <= k
            bound = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}
            for child, part, (lo, hi) in zip((used, used + 1), (rows[goes], rows[~goes]), bound[int(monotone[j])]):
                todo.append((child, part, lo, hi, level + 1))
            used += 2
        trees.append((feature, threshold, left, right, value))
    return Trees(*(np.stack(a) for a in zip(*trees)), base, depth)


def train(sample: DataFrame, text: str = "text", monotone: dict[str, int] | None = None, **options) -> Trees | None:
    """Trees from ``sample`` (``text``, ``label``), whose size its maker bounds; None unless it has both labels."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: base_counts(t)[1])

    rows = sample.select("doc_id", "label", measured(F.col(text)).alias("stats")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    y = rows["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return None
    signs = MONOTONE if monotone is None else monotone
    return fit_trees(
        np.array(rows["stats"].tolist()), y, np.array([signs.get(s, 0) for s in STATISTICS]), **options
    )


def judge(docs: DataFrame, trees: Trees | None, text: str = "text", bar: float = 0.5) -> DataFrame:
    """``docs`` with the five counts, ``base_failed``, the trees' ``quality`` and ``kept``.

    ``base_failed``: under 10 words, or over a fifth of the words repeated in windows. ``kept``: base passed and quality
    at least ``bar``; without trees quality is null and the base decides. Null texts count as empty and fail; repeated
    rows are judged each. Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("counts array<long>, quality double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = [base_counts(t) for t in texts]
        model = shared.value
        quality = None
        if model is not None and rows:
            quality = 1 / (1 + np.exp(-model.score(np.array([r[1] for r in rows]))))
        return pd.DataFrame({"counts": [r[0] for r in rows], "quality": quality}).astype({"quality": "float64"})

    out = docs.withColumn("__judged", judged(F.col(text)))
    out = out.withColumns({c: F.col("__judged.counts")[i] for i, c in enumerate(COUNTS)})
    quality = F.when(~F.isnan("__judged.quality"), F.col("__judged.quality"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        out.withColumns({"base_failed": failed, "quality": quality})
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("quality") >= bar, F.lit(True)))
        .drop("__judged")
    )
