"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in an order by hash, are one stream, cut into blocks of equal size. Time goes in slots, one block
each. Block i of a source of weight w may not start before floor(i / w) and must be done by ceil((i + 1) / w); the earliest
deadline goes first, which keeps every source less than one block from its weight at every time. Weights are fractions of a
period of at least half the square of the mixture's slots, so that their rounding moves no source by more than 2 / slots of
a block; the schedule is worked out for the slots of the mixture only.

The mixture goes on until every source has been delivered whole; a source that is through begins again (the next epoch).

Every source has its own weight. One that has less than a block, and whose weight comes to less than a block in the whole
mixture, is delivered once: a slot of its own would be more than its share. Such sources share the slots that their weights
come to together, each in the slot where its part of their joint stream begins. The driver holds a row for each slot and
each source of at least a block; the small sources stay in a table.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

PERIOD = 1024
BLOCK = 65_536
TEMPERATURE = 0.9
ROWS_PER_PART = 50_000
BROADCAST_ROWS = 1_000_000  # deliveries up to which the plan is sent to every executor
REST = "rest"
SMALL = "small"  # the joint stream of sources without slots of their own


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period for each positive weight, by largest remainders. A weight that gets none is left out."""
    used = {k: w for k, w in sorted(weights.items()) if w > 0}
    if len(used) > period:
        raise ValueError("more sources than slots of a period")
    total = math.fsum(used.values())
    exact = {k: w / total * period for k, w in used.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: period - sum(out.values()) if out else 0]:
        out[k] += 1
    return {k: n for k, n in out.items() if n}


def schedule(slots: dict[str, int], blocks: dict[str, int] | None = None, horizon: int = 0) -> list[str]:
    """The source of each slot, by earliest deadline among the released blocks: for one period, or, given their ``blocks``,
    until all sources have been delivered whole. The small sources' stream ends with its blocks, at slot ``horizon``."""
    period = sum(slots.values())
    waiting = [(0, k, 0) for k in slots]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    out: list[str] = []
    missing = len(blocks) if blocks is not None else None
    while missing if blocks is not None else len(out) < period:
        while waiting and waiting[0][0] <= len(out):
            _, k, i = heapq.heappop(waiting)
            due = -(-(i + 1) * period // slots[k])
            heapq.heappush(ready, (min(due, horizon) if k == SMALL else due, k, i))
        _, k, i = heapq.heappop(ready)
        out.append(k)
        last = blocks is not None and i + 1 == blocks[k]
        missing = missing - 1 if last else missing
        if not (last and k == SMALL):
            heapq.heappush(waiting, ((i + 1) * period // slots[k], k, i + 1))
    return out


def period_for(weights: dict[str, float], blocks: dict[str, int], least: int = PERIOD, horizon: int = 1) -> int:
    """``least`` doubled up to half the square of the slots (``horizon`` at least) in which all are delivered whole."""
    total = math.fsum(weights.values())
    horizon = max([horizon, *(math.ceil(n * total / weights[k]) for k, n in blocks.items())])
    while 2 * least < horizon * horizon:
        least *= 2
    return least


def deliveries(order: list[str], blocks: dict[str, int]) -> pd.DataFrame:
    """__class, block, epoch and slot of each slot of ``order``."""
    given: Counter[str] = Counter()
    turn = np.empty(len(order), dtype=np.int64)
    for at, k in enumerate(order):
        turn[at] = given[k]
        given[k] += 1
    whole = np.array([blocks[k] for k in order], dtype=np.int64)
    return pd.DataFrame({"__class": order, "block": turn % whole, "epoch": turn // whole, "slot": np.arange(len(order))})


def _name(source: Column) -> Column:
    """A null source is a source too, apart from all texts."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _size(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long") + 1


def tempered(docs: DataFrame, source: str = "source", text: str = "text", temperature: float = TEMPERATURE) -> dict:
    """The weight of every source, its size to the power of ``temperature``, on the driver. ``mix_sources`` without weights
    uses the same without collecting them."""
    sizes = docs.groupBy(_name(F.col(source)).alias("class")).agg(F.sum(_size(F.col(text))).alias("size"))
    return {r["class"]: float(r["size"]) ** temperature for r in sizes.collect()}


def _plan(classes: DataFrame, block: int, period: int, rows_per_part: int) -> tuple[DataFrame, int]:
    """__class, block, epoch, slot of each delivery of a block, and their number. ``classes``: __class, size, weight."""
    spark = classes.sparkSession
    size, weight, whole = F.col("size"), F.col("weight"), F.ceil(F.col("size") / block)
    total, volume, longest = classes.agg(
        F.sum("weight"), F.sum("size"), F.max(F.when(size >= block, whole / weight))
    ).first()
    content = -(-int(volume) // block)
    limit = max(period, content, math.ceil((longest or 0.0) * total))
    own = (size >= block) | (weight * limit >= total)
    big = classes.where(own).collect()  # at most one for each of ``limit`` slots, or of at least a block
    small = classes.where(~own).select("__class", "weight")
    n_small, joint = small.agg(F.count("*"), F.sum("weight")).first()
    blocks = {r["__class"]: -(-int(r["size"]) // block) for r in big}
    targets = {r["__class"]: r["weight"] for r in big} | ({SMALL: joint} if n_small else {})
    slots = shares(targets, period_for(targets, blocks, period, content))
    horizon = 0
    if n_small:
        slots.setdefault(SMALL, 1)
        all_slots = sum(slots.values())
        horizon = max([content, *(-(-n * all_slots // slots[k]) for k, n in blocks.items())])
        blocks[SMALL] = -(-slots[SMALL] * horizon // all_slots)
    sent = deliveries(schedule(slots, blocks, horizon), blocks)
    shared = sent["__class"] == SMALL
    plan = spark.createDataFrame(sent[~shared], "__class string, block long, epoch long, slot long")
    if not n_small:
        return plan, len(sent)
    # the small sources' stream in the order of a hash, summed in parts of its range; whole units, so that sums are exact
    units = F.floor(weight / F.lit(joint) * (1 << 40)) + 1
    part = F.shiftright("__at", 64 - max(1, (n_small // rows_per_part).bit_length()))
    small = small.withColumns({"__at": F.xxhash64("__class"), "__units": units}).withColumn("__part", part)
    sums = small.groupBy("__part").agg(F.sum("__units").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a few rows
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    all_units = sums.agg(F.sum("__sum")).first()[0]
    inside = Window.partitionBy("__part").orderBy("__at", "__class").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.col("__before") + F.coalesce(F.sum("__units").over(inside), F.lit(0))
    turn = F.least(F.floor(begins / F.lit(all_units) * blocks[SMALL]), F.lit(blocks[SMALL] - 1))
    spots = spark.createDataFrame(sent.loc[shared, ["block", "slot"]], "__turn long, slot long")
    zero = F.lit(0).cast("long")
    once = (
        small.join(F.broadcast(sums), "__part").withColumn("__turn", turn.cast("long")).join(spots, "__turn")
        .select("__class", zero.alias("block"), zero.alias("epoch"), "slot")
    )
    return stored(plan.unionByName(once)), len(sent) + n_small


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", text: str = "text",
    key: str = "doc_id", block: int = BLOCK, period: int = PERIOD, rows_per_part: int = ROWS_PER_PART,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """``docs`` with ``block`` (of its source), ``epoch`` and ``slot``, once for each delivery.

    Without ``weights`` every source's is its size to the power of ``temperature``. ``weights``: by class, ``=name`` for a
    source, ``null`` for rows without, ``rest`` for all others (without it they share the mean weight). Classes without rows or weight take no slots, but rows are never left out: a class with
    rows and no positive weight counts as part of the rest. A document has its text's code points and one more as size and
    belongs to the block its first falls into. Null keys, repeated rows and ties in the order are rows like others.
    Columns of the result's names are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("block", "epoch", "slot")
    name = _name(F.col(source))
    if weights is None:
        class_of = name
    else:
        known = sorted(k for k, w in weights.items() if w > 0 and k != REST)
        class_of = F.when(name.isin(known), name).otherwise(F.lit(REST)) if known else F.lit(REST)
    rows = docs.withColumns({"__class": class_of, "__hash": F.xxhash64(key), "__size": _size(F.col(text))})
    total = rows.count()
    if not total:
        return docs.withColumns({c: F.lit(0).cast("long") for c in ("block", "epoch", "slot")})
    # a class is summed in parts of its hash range, so that a large one is no single task's
    bits = max(1, (total // rows_per_part).bit_length())
    part = F.shiftright("__hash", 64 - bits)
    rows = rows.withColumn("__part", part)
    sums = rows.groupBy("__class", "__part").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy("__class").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))))
    inside = (
        Window.partitionBy("__class", "__part").orderBy("__hash", key, "__size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.join(sums.select("__class", "__part", "__before"), ["__class", "__part"]).withColumn(
        "block", F.floor((F.col("__before") + F.coalesce(F.sum("__size").over(inside), F.lit(0))) / block)
    )
    classes = sums.groupBy("__class").agg(F.sum("__sum").alias("size"))
    if weights is None:
        classes = classes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        mean = sum(weights[k] for k in known) / len(known) if known else 1.0
        rest = weights.get(REST, 0)
        given = spark.createDataFrame([(k, float(weights[k])) for k in known], "__class string, weight double")
        other = F.lit(float(rest if rest > 0 else mean))
        classes = classes.join(given, "__class", "left").withColumn("weight", F.coalesce("weight", other))
    plan, n = _plan(stored(classes), block, period, rows_per_part)
    if n <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    return placed.join(plan, ["__class", "block"]).select(*docs.columns, "block", "epoch", "slot")
