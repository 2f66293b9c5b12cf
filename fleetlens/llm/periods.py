"""Periodic runs of words by a dictionary of basic factors.

A basic factor is a stretch of 2^k words; the factors of one level get one number exactly where their words agree, made
from the numbers of their halves. A factor that occurs once in its text is part of no repetition, so each level keeps only
places whose factor recurs. Where the next occurrence of a factor of length L follows at a distance d <= L, so that both
lie within twice its length, the text has period d from the one to the end of the other, and d is the smallest period
there, as a smaller one would show as a nearer occurrence. Neighbouring places of equal distance are the progression of one
run: c of them extend to c - 1 + L + d words, and neither neighbour of these fits the period, or it would belong to the
progression. Each level with L >= d finds a run that has L + d words; equal finds are deduplicated. The least such L is
below 2 d, so no run of three periods is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

LEAST_WORDS = 24
LEAST_PERIODS = 3
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
ADDED = {"n_words": T.LongType(), "runs": T.ArrayType(RUN), "collapsed": T.StringType()}
PART_BYTES = 4_000_000  # of results that a task holds


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def recurring(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose name occurs again in the text, their names numbered anew, and the distance to the next place of the
    same name (0 at the last one). ``at`` ascends."""
    if not len(at):
        return at, at, at
    order = np.argsort(names, kind="stable")  # places of one name follow each other, ascending
    same = names[order][1:] == names[order][:-1]
    again = np.r_[same, False] | np.r_[False, same]
    gap = np.r_[np.where(same, np.diff(at[order]), 0), 0]
    number = np.cumsum(np.r_[0, ~same])
    kept = np.sort(order[again])
    back = np.empty((2, len(at)), dtype=np.int64)
    back[:, order] = number, gap
    return at[kept], back[0, kept], back[1, kept]


def find_runs(
    words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> np.ndarray:
    """(start, length, period) of every run of ``words``, by start, then period."""
    found = [np.empty((0, 3), dtype=np.int64)]
    n, length = len(words), 1
    if n < max(least_words, least_periods):
        return found[0]
    at, name = np.arange(n), numbered(words)
    while len(at):
        at, name, gap = recurring(name, at)
        near = np.flatnonzero((gap > 0) & (gap <= length))
        if len(near):
            place, period = at[near], gap[near]
            first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])])
            size = np.diff(np.r_[first, len(near)]) - 1 + length + period[first]
            found.append(np.stack([place[first], size, period[first]], axis=1))
            found[-1] = found[-1][size >= np.maximum(least_words, least_periods * period[first])]
        if length * least_periods >= n:
            break  # no longer period fits the text so often
        half = np.searchsorted(at, at + length)
        half[half == len(at)] = 0
        whole = np.flatnonzero(at[half] == at + length) if len(at) else half
        at, name, length = at[whole], name[whole] * (n + 1) + name[half[whole]], 2 * length
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated_words(n: int, runs: np.ndarray) -> np.ndarray:
    """For each of ``n`` words whether some run holds it after the run's first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps)[:n] > 0


def periodic_runs(
    docs: DataFrame, text: str | Column = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) with ``n_words``, ``runs`` and ``collapsed``.

    ``runs``: every maximal stretch of words of smallest period q that is at least ``least_words`` and ``least_periods``
    times q long, as (start, length, period) by start, then period. ``least_periods`` is 3 or more. ``collapsed``: the
    words that no run holds after its first period, joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``; null and
    empty texts have none. Every row is searched by itself and whole, so repeated rows and null ids do not matter. Columns
    of the three names are replaced. A text is held by one task, as is any cell of a table; other texts of its batch stay
    in Arrow until their turn, and results leave in parts of bounded size."""
    if least_periods < 3:
        raise ValueError("basic factors propose every period only from three periods on")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in ADDED.items()])
    types = [to_arrow_type(t) for t in ADDED.values()]

    def part(batch, start, made):
        own = [batch.column(i).slice(start, len(made)) for i in range(len(kept))]
        return pa.RecordBatch.from_arrays(own + [pa.array(m, t) for m, t in zip(zip(*made), types)], schema.fieldNames())

    def run(batches):
        for batch in batches:
            start, size, made = 0, 0, []
            for i in range(batch.num_rows):
                t = batch.column(len(kept))[i].as_py()
                words = t.encode().split() if t else []
                runs = find_runs(words, least_words, least_periods)
                left = words
                if len(runs):
                    left = [words[j] for j in np.flatnonzero(~repeated_words(len(words), runs)).tolist()]
                found = [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()]
                made.append((len(words), found, b" ".join(left).decode()))
                size += len(made[-1][2]) + 64 * len(found) + 64
                if size >= PART_BYTES:
                    yield part(batch, start, made)
                    start, size, made = i + 1, 0, []
            if made:
                yield part(batch, start, made)

    rows = docs.select(*kept, (F.col(text) if isinstance(text, str) else text).alias("__text"))
    return rows.mapInArrow(run, schema)


def highest(runs: Column) -> Column:
    """The run of greatest exact length / period; ties to the smaller start, then period; null without runs."""
    lead = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    better = lambda a, b: a.isNull() | (lead(b, a) > 0)  # noqa: E731 - runs come by start, then period
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda a, b: F.when(better(a, b), b).otherwise(a))
