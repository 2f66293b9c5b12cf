"""Ordered computations per key that stay parallel when one key is hot.

A window over ``partitionBy(key).orderBy(time)`` puts a whole key into one
task. Here a key with more than ``rows_per_task`` rows is cut into consecutive
segments of its order; the window runs per (key, segment) and the segments are
joined up by a carry taken from one small summary row per segment. Keys below
the limit keep the plain window, so ordinary data pay for one sampled count only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import written

ROWS_PER_TASK = 4_000_000
MAX_CUTS = 8192  # cuts of one hot key; all keys together have about rows / rows_per_task of them
NESTED_CUTS = 64  # up to which cuts are nested conditions
BROADCAST_ROWS = 10_000  # of a list of keys that the driver holds anyway
SAMPLE_ROWS = 4096  # sampled rows by which a key counts as large
SEG = "_seg"
SUB = 4096  # room for second-level segments inside one tied order value


class Scan(NamedTuple):
    """kind: row_number, sum, max, min, last (latest non-null) or lag (previous row)."""

    kind: str
    expr: Column | None = None


@dataclass(frozen=True)
class Segmented:
    df: DataFrame
    by: list[str]
    order: list[str]
    segments: int  # segments over all hot keys; 0 = nothing was split

    def with_df(self, df: DataFrame) -> Segmented:
        return Segmented(df, self.by, self.order, self.segments)

    def once(self) -> Segmented:
        """Split rows are read twice by a scan, for the rows and for the carries, so they are written first.

        A chain of scans thus reads each step's rows twice, and not the input twice for every step."""
        return self.with_df(written(self.df, "segments")) if self.segments else self

    @property
    def group(self) -> list[str]:
        return [*self.by, SEG] if self.segments else self.by

    def done(self) -> DataFrame:
        return self.df.drop(SEG)


def same_key(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    """Null-safe equality of ``keys`` in left with ``prefix + key`` in right."""
    parts = [left[k].eqNullSafe(right[prefix + k]) for k in keys]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what is known to be small; otherwise Spark chooses the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def position(df: DataFrame, col: str) -> Column:
    """Order column as a number, for choosing cuts; it never runs against the column's order.

    A text counts by its seven bytes after the prefix that all values share.
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(dtype, T.NumericType):
        return F.col(col)
    if isinstance(dtype, T.StringType):
        low, high = (x.encode() for x in df.agg(F.coalesce(F.min(col), F.lit("")), F.coalesce(F.max(col), F.lit(""))).first())
        shared = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        part = F.hex(F.substring(F.encode(F.col(col), "UTF-8"), shared + 1, 7))
        return F.conv(F.rpad(part, 14, "0"), 16, 10).cast("long")
    raise ValueError(f"order column {col} cannot be cut into ranges")


def _between_cuts(value: Column, cuts: list, base: int) -> Column:
    """base + 2 * (cuts below value) + (value is a cut), by binary search: few cuts as nested conditions, which Spark
    compiles, many over one Arrow column."""
    if len(cuts) <= NESTED_CUTS:

        def among(a: int, b: int) -> Column:
            if a == b:
                return F.lit(base + 2 * a).cast("long")
            m = (a + b) // 2
            here = F.lit(base + 2 * m + 1).cast("long")
            return F.when(value < F.lit(cuts[m]), among(a, m)).when(value == F.lit(cuts[m]), here).otherwise(among(m + 1, b))

        return F.when(value.isNotNull(), among(0, len(cuts))).otherwise(base + 1)
    at = np.array(cuts)

    @F.pandas_udf("long")
    def place(v: pd.Series) -> pd.Series:
        below = np.searchsorted(at, v.to_numpy(), side="left")
        return pd.Series(base + below + np.searchsorted(at, v.to_numpy(), side="right"))

    return place(F.coalesce(value, F.lit(cuts[0])))


def _quantiles(df: DataFrame, keys: list[str], value: Column, n: int, sizes: dict[tuple, int] | None = None) -> list[list]:
    """Quantiles per key, each key with as many as its size in ``sizes`` asks for (default: n)."""
    probs = [i / n for i in range(1, n)]
    rows = df.groupBy(*keys).agg(F.percentile_approx(value, probs, 20 * n).alias("q")).collect()
    out = []
    for r in rows:
        q, own = r["q"] or [], n if sizes is None else sizes.get(tuple(r[k] for k in keys), n)
        out.append(q if own >= n else [q[i * n // own - 1] for i in range(1, own)] if q else [])
    return out


def large_keys(df: DataFrame, by: list[str], limit: int) -> tuple[list[Row], float]:
    """Keys with more than ``limit`` rows and their size ``_n``, by a sample, and the share sampled.

    There are about rows / limit of them, however many keys there are.
    """
    share = min(1.0, SAMPLE_ROWS / limit)
    seen = df.sample(share, 17) if share < 1 else df
    counts = seen.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(share)).alias("_n"))
    return counts.filter(F.col("_n") > limit).collect(), share


def cut_join(
    left: DataFrame, right: DataFrame, on: list[str], spread: Column, rows_per_task: int = ROWS_PER_TASK,
    sampled: DataFrame | None = None,
) -> DataFrame:
    """Inner join in which a key of more than ``rows_per_task`` rows of ``left`` is cut into pieces by the column
    ``spread``; each piece meets its own copy of the key's rows of ``right``, which should be few. ``sampled`` stands in
    for ``left`` where it is cheaper to read and has no fewer rows of any key."""
    large, _ = large_keys(left if sampled is None else sampled, on, rows_per_task)
    large = [r for r in large if all(r[k] is not None for k in on)]  # null meets nothing
    if not large:
        return left.join(right, on)
    schema = T.StructType([left.schema[k] for k in on] + [T.StructField("_cuts", T.LongType())])
    cuts = left.sparkSession.createDataFrame([(*[r[k] for k in on], -(-r["_n"] // rows_per_task)) for r in large], schema)
    cuts, n = bounded_broadcast(cuts, len(large)), F.coalesce("_cuts", F.lit(1))
    left = left.join(cuts, on, "left").withColumn("_piece", F.pmod(F.xxhash64(spread), n)).drop("_cuts")
    right = right.join(cuts, on, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("_cuts")
    return left.join(right, [*on, "_piece"]).drop("_piece")


def split(df: DataFrame, by: list[str], order: list[str], rows_per_task: int = ROWS_PER_TASK) -> Segmented:
    """Add a segment column where keys hold more than ``rows_per_task`` rows.

    Large keys and their cuts are estimated on a sample, because they only decide how the work is
    divided: every row is kept, and the results do not depend on where the cuts fall.
    """
    hot, share = large_keys(df, by, rows_per_task)
    if not hot:
        return Segmented(df, by, order, 0)
    spark = df.sparkSession
    biggest = max(r["_n"] for r in hot)
    n = min(MAX_CUTS, -(-biggest // rows_per_task) + 1)
    if by:
        key_schema = T.StructType([T.StructField("_h_" + k, df.schema[k].dataType) for k in by])
        keys = bounded_broadcast(
            spark.createDataFrame([tuple(r[k] for k in by) for r in hot], key_schema).withColumn("_hot", F.lit(True)),
            len(hot),
        )
        marked = df.join(keys, same_key(df, keys, by, "_h_"), "left").drop(*["_h_" + k for k in by])
    else:
        marked = df.withColumn("_hot", F.lit(True))
    hot_rows = (marked.sample(share, 17) if share < 1 else marked).filter("_hot")
    first = position(df, order[0])
    sizes = {tuple(r[k] for k in by): min(MAX_CUTS, -(-r["_n"] // rows_per_task) + 1) for r in hot}
    per_key = _quantiles(hot_rows, by, first, n, sizes)
    cuts = sorted({c for q in per_key for c in q if c is not None})
    if not cuts:
        return Segmented(df, by, order, 0)  # the order column is null throughout
    seg = F.when(first.isNull(), F.lit(1)).otherwise(_between_cuts(first, cuts, 2)) * SUB
    tied = sorted({c for q in per_key for c, d in zip(q, q[1:]) if c == d} & set(cuts))
    sub_cuts: list = []
    if tied and len(order) > 1:
        # one order value holds several segments' worth of rows: cut it by the next column
        second = position(df, order[1])
        at_tie = hot_rows.filter(first.isin(tied)).withColumn("_t", first)
        per_tie = _quantiles(at_tie, [*by, "_t"], second, n)
        sub_cuts = sorted({c for q in per_tie for c in q if c is not None})
        sub_cuts = sub_cuts[:: max(1, -(-len(sub_cuts) // (SUB // 2 - 2)))]
        if sub_cuts:
            sub = F.when(second.isNull(), F.lit(0)).otherwise(_between_cuts(second, sub_cuts, 1))
            seg = seg + F.when(first.isin(tied), sub).otherwise(0)
    out = marked.withColumn(SEG, F.when(F.col("_hot"), seg).otherwise(0)).drop("_hot")
    per_hot_key = 2 * (len(cuts) + len(tied) * len(sub_cuts)) + 2
    return Segmented(out, by, order, len(hot) * per_hot_key)


def scan(s: Segmented, cols: dict[str, Scan], reverse: bool = False) -> Segmented:
    """Running values per key in order (or in reverse order), inclusive of the row."""
    s = s.once()
    turn = (lambda c: F.col(c).desc()) if reverse else F.col
    ordered = Window.partitionBy(*s.group).orderBy(*[turn(c) for c in s.order])
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for name, (kind, expr) in cols.items():
        if kind == "row_number":
            local[name] = F.row_number().over(ordered).cast("long")
        elif kind == "sum":
            local[name] = F.sum(expr).over(running)
        elif kind in ("max", "min"):
            local[name] = getattr(F, kind)(expr).over(running)
        elif kind == "last":
            local[name] = F.last(expr, ignorenulls=True).over(running)
        elif kind == "lag":
            local[name] = F.lag(F.struct(expr.alias("v"))).over(ordered)
        else:
            raise ValueError(f"unknown scan {kind}")
    out = s.df.withColumns(local)
    if not s.segments:
        return s.with_df(out.withColumns({n: F.col(n)["v"] for n, c in cols.items() if c.kind == "lag"}))

    at = F.struct(*s.order)
    end = F.min_by if reverse else F.max_by
    totals = []
    for name, (kind, expr) in cols.items():
        if kind == "row_number":
            agg = F.count(F.lit(1))
        elif kind == "sum":
            agg = F.sum(expr)
        elif kind in ("max", "min"):
            agg = getattr(F, kind)(expr)
        elif kind == "last":
            agg = end(expr, F.when(expr.isNotNull(), at))
        else:
            agg = end(F.struct(expr.alias("v")), at)
        totals.append(agg.alias("_c_" + name))
    summary = s.df.filter(F.col(SEG) > 0).groupBy(*s.group).agg(*totals)
    before = Window.partitionBy(*s.by).orderBy(turn(SEG)).rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for name, (kind, _) in cols.items():
        c = F.col("_c_" + name)
        if kind in ("row_number", "sum"):
            carries.append(F.sum(c).over(before).alias("_c_" + name))
        elif kind in ("max", "min"):
            carries.append(getattr(F, kind)(c).over(before).alias("_c_" + name))
        else:
            carries.append(F.last(c, ignorenulls=True).over(before).alias("_c_" + name))
    # a carry holds any expression, so its size isn't known here: Spark measures it and chooses the join
    carry = summary.select(*[F.col(k).alias("_k_" + k) for k in s.group], *carries)
    joined = out.join(carry, same_key(out, carry, s.group, "_k_"), "left")
    final = {}
    for name, (kind, _) in cols.items():
        mine, prior = F.col(name), F.col("_c_" + name)
        if kind in ("row_number", "sum"):
            final[name] = F.coalesce(mine + prior, mine, prior)
        elif kind == "max":
            final[name] = F.greatest(mine, prior)
        elif kind == "min":
            final[name] = F.least(mine, prior)
        elif kind == "last":
            final[name] = F.coalesce(mine, prior)
        else:
            final[name] = F.coalesce(mine, prior)["v"]
    drop = ["_k_" + k for k in s.group] + ["_c_" + n for n in cols]
    return s.with_df(joined.withColumns(final).drop(*drop))


def running(df, by, order, cols, rows_per_task=ROWS_PER_TASK, reverse=False) -> DataFrame:
    """One scan over a frame that is split on the spot."""
    return scan(split(df, by, order, rows_per_task), cols, reverse).done()


def ranged(
    df: DataFrame, by: list[str], at: Column, lo: int, hi: int, cols: dict[str, Scan], rows_per_task: int = ROWS_PER_TASK,
    positions: int | None = None,
) -> DataFrame:
    """min, max, sum or count over rows of the same key with position in [at + lo, at + hi].

    ``at`` is a whole number (seconds, micros, ticks). Rows are first reduced to one per key and
    position. Time is cut into buckets as wide as the range, so every range is the end of one bucket
    and the start of the next: two running aggregates per bucket answer all ranges, in time linear
    in the rows. A bucket has at most ``positions`` rows of a key (default: its width); where that may
    be more than ``rows_per_task``, buckets that a sample shows to be so full are cut as well.
    """
    width = hi - lo
    if width <= 0:
        raise ValueError("the range must have a positive width")
    merge = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
    first = {**merge, "count": F.count}
    rows = df.withColumn("_at", at)
    per = rows.groupBy(*by, "_at").agg(*[first[c.kind](c.expr).alias(n) for n, c in cols.items()])
    bucket = lambda pos: F.floor(pos / F.lit(width)).cast("long")
    none = {n: F.lit(None).cast(per.schema[n].dataType) for n in cols}

    def entry(pos, side, values):
        return F.struct(
            bucket(pos).alias("_bucket"), pos.alias("_pos"), F.lit(side).alias("_side"),
            *[v.alias(n) for n, v in values.items()]
        )

    own = entry(F.col("_at"), 0, {n: F.col(n) for n in cols})
    begins, ends = entry(F.col("_at") + lo, 1, none), entry(F.col("_at") + hi, 2, none)
    points = per.select(*by, "_at", F.explode(F.array(own, begins, ends)).alias("p")).select(*by, "_at", "p.*")
    # at equal positions values come before the ends of ranges, in either direction
    points = points.withColumns({"_asked": (F.col("_side") > 0).cast("int"), "_held": (F.col("_side") == 0).cast("int")})
    spot = [*by, "_bucket"]
    cut = Segmented(points, spot, ["_pos"], 0)
    if 3 * (positions or width) > rows_per_task:
        full, _ = large_keys(rows.withColumn("_bucket", bucket(F.col("_at"))), spot, max(1, rows_per_task // 3))
        cut = split(points, spot, ["_pos"], rows_per_task) if full else cut
    kinds = {n: "sum" if c.kind == "count" else c.kind for n, c in cols.items()}
    upto = scan(Segmented(cut.df, spot, ["_pos", "_asked"], cut.segments), {"_up_" + n: Scan(k, F.col(n)) for n, k in kinds.items()})
    both = scan(
        Segmented(upto.df, spot, ["_pos", "_held"], cut.segments), {"_on_" + n: Scan(k, F.col(n)) for n, k in kinds.items()}, reverse=True
    )
    part = {n: F.when(F.col("_side") == 1, F.col("_on_" + n)).when(F.col("_side") == 2, F.col("_up_" + n)) for n in cols}
    halves = both.done().select(*by, "_at", "_side", *[v.alias(n) for n, v in part.items()]).filter("_side > 0")
    whole = halves.groupBy(*by, "_at").agg(*[merge[c.kind](n).alias(n) for n, c in cols.items()])
    keys = [*by, "_at"]
    found = whole.select(*[F.col(k).alias("_k_" + k) for k in keys], *cols)
    return rows.join(found, same_key(rows, found, keys, "_k_"), "left").drop("_at", *["_k_" + k for k in keys])
