"""Nesting, foreign keys, uniqueness, upserts and partial updates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.operators.components import components
from fleetlens.operators.segments import ROWS_PER_TASK, Scan, bounded_broadcast, large_keys, running
from fleetlens.session import written

PAGE_ROWS = 1000


def pages_of(
    child: DataFrame, fk: list[str], order: list[str], fields: list[str], as_: str, page_rows: int = PAGE_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Children of each key as lists of at most ``page_rows``, numbered from page 0.

    A list of all children of a hot parent would not fit one row; its list goes on in
    further pages, and nothing is dropped. Positions come from a segmented scan.
    """
    keep = list(dict.fromkeys([*fk, *order, *fields]))
    ranked = running(child.select(*keep), fk, order, {"_pos": Scan("row_number")}, rows_per_task)
    item = F.struct(F.col("_pos"), F.struct(*fields).alias("item"))
    grouped = ranked.groupBy(*fk, F.expr(f"(_pos - 1) div {page_rows}").alias("page")).agg(
        F.array_sort(F.collect_list(item)).alias("_items")
    )
    return grouped.select(*fk, "page", F.transform("_items", lambda i: i["item"]).alias(as_))


def nest(
    parent: DataFrame, child: DataFrame, pk: str, fk: str, as_: str, order: list[str], fields: list[str],
    page_rows: int = PAGE_ROWS, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Parents with their children as a list; a childless parent has one empty page."""
    lists = pages_of(child, [fk], order, fields, as_, page_rows, rows_per_task).withColumnRenamed(fk, "_fk")
    empty = F.array().cast(lists.schema[as_].dataType)
    joined = parent.join(lists, parent[pk] == lists["_fk"], "left").drop("_fk")
    return joined.withColumns({"page": F.coalesce("page", F.lit(0)), as_: F.coalesce(F.col(as_), empty)})


def nest2(
    top: DataFrame, middle: DataFrame, bottom: DataFrame, top_key: str, middle_top: str, middle_key: str,
    bottom_middle: str, as_: tuple[str, str], middle_fields: list[str], bottom_fields: list[str],
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Two levels, built bottom up. A middle row that needs several pages appears once per page."""
    inner = nest(middle, bottom, middle_key, bottom_middle, as_[1], bottom_fields[:1], bottom_fields, page_rows)
    inner = inner.withColumnRenamed("page", "part")
    return nest(top, inner, top_key, middle_top, as_[0], [middle_key, "part"], [*middle_fields, "part", as_[1]], page_rows)


KEY_ROWS = 500_000  # rows that one task sorts to look their keys up


def _dealt(rows: DataFrame, keys: DataFrame, key: str, rows_per_task: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and ``keys`` (of column ``_key``) dealt by key over tasks of about ``rows_per_task`` rows, and the columns
    that they meet on. The session's number of partitions would let one task's sort grow with the table.

    Skewed partitions of a given number are not split by Spark, so a key of more rows is cut into pieces by a hash of
    the row, each of which meets its own copy of the key. Null meets nothing and needs no copies."""
    rows = rows.withColumn("_key", F.col(key))
    n = -(-rows.count() // rows_per_task)
    if n <= 1 or keys.schema["_key"].dataType != rows.schema[key].dataType:
        return rows, keys, ["_key"]
    large, _ = large_keys(rows.select("_key"), ["_key"], rows_per_task)
    if not large:
        return rows.repartition(n, "_key"), keys.repartition(n, "_key"), ["_key"]
    schema = T.StructType([rows.schema["_key"], T.StructField("_cuts", T.LongType())])
    known = [(r["_key"], -(-r["_n"] // rows_per_task)) for r in large if r["_key"] is not None]
    cuts, many = bounded_broadcast(rows.sparkSession.createDataFrame(known, schema), len(known)), F.coalesce("_cuts", F.lit(1))
    spread = F.xxhash64(*[c for c, kind in rows.dtypes if not any(k in kind for k in ("map<", "variant"))])
    pieces = F.when(F.col("_key").isNull(), F.lit(n)).otherwise(many)
    rows = rows.join(cuts, "_key", "left").withColumn("_piece", F.pmod(spread, pieces)).drop("_cuts")
    keys = keys.join(cuts, "_key", "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("_cuts")
    on = ["_key", "_piece"]
    return rows.repartition(n, *on), keys.repartition(n, *on), on


def _looked_up(rows: DataFrame, keys: DataFrame, key: str, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among ``keys`` (of column ``_key``), and the others."""
    dealt, keys, on = _dealt(rows, keys, key, rows_per_task)
    # an outer join, as Spark would move a semi or anti join before the dealing
    met = dealt.join(keys.distinct().withColumn("_met", F.lit(True)), on, "left")
    return met.filter("_met").select(*rows.columns), met.filter("_met IS NULL").select(*rows.columns)


def enforce_fk(
    child: DataFrame, parent: DataFrame, fk: str, pk: str, rows_per_task: int = KEY_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Children whose parent exists, and orphans."""
    return _looked_up(child, parent.select(F.col(pk).alias("_key")), fk, rows_per_task)


def delete_cascade(
    parent: DataFrame, child: DataFrame, keys: DataFrame, pk: str, fk: str, rows_per_task: int = KEY_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents in ``keys`` (column pk) and their children."""
    gone = keys.select(F.col(pk).alias("_key"))
    return _looked_up(parent, gone, pk, rows_per_task)[1], _looked_up(child, gone, fk, rows_per_task)[1]


def _least(rows: DataFrame, value: str, place: Column, named: str) -> DataFrame:
    """Least place per value; combined before the shuffle, so a value of very many rows stays spread out."""
    return rows.groupBy(F.col(value).alias(f"_{named}")).agg(F.min(place).alias(f"_{named}_at"))


WHOLE_ROWS = 500_000  # clashing rows that one task settles in order


def _settled_batches(keys: list[str], out_schema: pa.Schema):
    """Rows in order within each bucket in, those that no accepted row before them clashes with out."""

    def run(batches):
        bucket, held = None, [set() for _ in keys]
        for batch in batches:
            won, buckets = [], batch.column("_bucket").to_pylist()
            for i, (b, *values) in enumerate(zip(buckets, *(batch.column(k).to_pylist() for k in keys))):
                if b != bucket:
                    bucket, held = b, [set() for _ in keys]
                if not any(v in h for v, h in zip(values, held)):
                    won.append(i)
                    for v, h in zip(values, held):
                        if v is not None:
                            h.add(v)
            yield batch.take(pa.array(won, pa.int64())).select(out_schema.names)

    return run


def _settle_whole(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Accepted rows, where rows of one ``_bucket`` clash with each other only and are few enough for one task."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_bucket"])
    fed = rows.repartition("_bucket").sortWithinPartitions("_bucket", *order)
    return fed.mapInArrow(_settled_batches(keys, to_arrow_schema(schema)), schema)


def _clash_buckets(rows: DataFrame, keys: list[str], whole: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``_bucket`` that holds whole components of clashes, and rows of components above ``whole``."""
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "clashes")
    links = []
    for k in keys:
        hub = rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("_row").alias("_hub"), F.count(F.lit(1)).alias("_n"))
        links.append(rows.join(hub.filter("_n > 1"), k).select(F.col("_row").alias("a"), F.col("_hub").alias("b")))
    found = components(reduce(DataFrame.unionAll, links)).select(F.col("node").alias("_row"), "component")
    found = found.withColumnRenamed("component", "_part")
    named = rows.join(found, "_row", "left").withColumn("_part", F.coalesce("_part", "_row")).drop("_row")
    named = written(named, "clashes")
    large = named.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > whole)
    large = written(large.select("_part"), "large-clashes")  # at most rows / whole of them
    buckets = max(1, -(-2 * named.count() // whole))
    few = named.join(large, "_part", "left_anti").withColumn("_bucket", F.pmod(F.xxhash64("_part"), F.lit(buckets)))
    return few.drop("_part"), named.join(large, "_part", "left_semi").drop("_part")


def _settle_in_rounds(
    rows: DataFrame, keys: list[str], order: list[str], whole: int, holders: Callable[[DataFrame, DataFrame, str], DataFrame]
) -> list[DataFrame]:
    """Accepted rows by rounds: a row with no open row before it under any key is accepted, which refuses those it
    clashes with, until few enough are open for one task."""
    place, accepted, open_ = F.struct(*order), [], rows
    while True:
        open_ = written(open_, "open")
        if open_.count() <= whole:
            return [*accepted, _settle_whole(open_.withColumn("_bucket", F.lit(0).cast("long")), keys, order)]
        seen = holders(open_, open_, "open")
        first = reduce(lambda a, b: a & b, [
            F.col(f"_open{i}_at").isNull() | (F.col(f"_open{i}_at") == place) for i in range(len(keys))
        ])
        seen = written(seen.withColumn("_first", first).select(*rows.columns, "_first"), "open")
        won = seen.filter("_first").drop("_first")
        accepted.append(won)
        rest = holders(seen.filter("NOT _first").drop("_first"), won, "won")
        lost = F.coalesce(*[F.col(f"_won{i}_at") for i in range(len(keys))]).isNotNull()
        open_ = rest.filter(~lost).select(*rows.columns)


def reject_duplicates(
    new: DataFrame, existing: DataFrame, keys: list[tuple[str, str]], order: list[str], whole: int = WHOLE_ROWS
) -> DataFrame:
    """Error of each new row whose value of a key is held by an existing row or an earlier accepted new one.

    ``keys`` are (column, message); ``order`` columns stand in both tables and are unique in each. The holder that
    came first decides the message, and of one holder the first key. A refused row holds nothing, so whether a row is
    accepted may depend on any chain of clashes before it. Up to ``whole`` open rows are settled in order by one task;
    more are parted into components of clashes, which do not touch each other and share tasks of that size; a component
    above it goes in rounds until so few of it are open.
    """
    place = F.struct(*order)
    names = [k for k, _ in keys]
    rows = new.select(*dict.fromkeys([*order, *names]))

    def holders(of: DataFrame, from_: DataFrame, tag: str) -> DataFrame:
        for i, k in enumerate(names):
            least = _least(from_, k, place, f"{tag}{i}")
            of = of.join(least, F.col(k) == F.col(f"_{tag}{i}"), "left").drop(f"_{tag}{i}")
        return of

    old = holders(rows, existing, "old")
    taken = F.coalesce(*[F.col(f"_old{i}_at") for i in range(len(keys))]).isNotNull()
    open_ = written(old.filter(~taken).select(*rows.columns), "open")
    if open_.select()._jdf.javaRDD().count() <= whole:  # one job, where count() of the DataFrame takes two
        parts = [_settle_whole(open_.withColumn("_bucket", F.lit(0).cast("long")), names, order)]
    else:
        few, many = _clash_buckets(open_, names, whole)
        parts = [_settle_whole(few, names, order)]
        if not many.isEmpty():
            parts += _settle_in_rounds(many, names, order, whole, holders)
    accepted = written(reduce(DataFrame.unionByName, parts), "accepted")
    # the earliest holder of any of a row's values: existing rows first, then accepted ones that came before it
    out = holders(holders(new, existing, "old"), accepted, "won")
    clashes = []
    for i, (_, message) in enumerate(keys):
        before = F.when(F.col(f"_won{i}_at") < place, F.struct(F.lit(1).alias("s"), F.col(f"_won{i}_at").alias("at")))
        held = F.when(F.col(f"_old{i}_at").isNotNull(), F.struct(F.lit(0).alias("s"), F.col(f"_old{i}_at").alias("at")))
        holder = F.coalesce(held, before)
        clashes.append(F.when(holder.isNotNull(), F.struct(holder.alias("h"), F.lit(i).alias("i"), F.lit(message).alias("m"))))
    error = F.least(*clashes)["m"] if len(clashes) > 1 else clashes[0]["m"]
    helpers = [f"_{tag}{i}_at" for i in range(len(keys)) for tag in ("old", "won")]
    return out.withColumn("error", error).drop(*helpers)


def with_owner(items: DataFrame, users: DataFrame, owner_id: str, user_id: str, fields: list[str]) -> DataFrame:
    owner = users.select(F.col(user_id).alias("_uid"), F.struct(*fields).alias("owner"))
    return items.join(owner, items[owner_id] == owner["_uid"], "left").drop("_uid")


def with_items(users: DataFrame, items: DataFrame, user_id: str, owner_id: str, order: list[str], fields: list[str]) -> DataFrame:
    return nest(users, items, user_id, owner_id, "items", order, fields)


def resolve_user(df: DataFrame, directory: DataFrame, email: str, user_id: str = "user_id") -> DataFrame:
    """Directory lookup by e-mail as given; rows without a match keep a reason."""
    people = directory.select(F.col("email").alias("_email"), F.col(user_id).alias("resolved_id"))
    out = df.join(people, df[email] == people["_email"], "left").drop("_email")
    address = F.coalesce(F.col(email), F.lit(""))
    # fixed values: the reasons
    reason = F.when(~F.contains(address, F.lit("@")), F.concat(F.lit("Invalid email format: "), address)).when(
        F.col("resolved_id").isNull(), F.concat(F.lit("Slack user not found for email: "), address)
    )
    return out.withColumn("reason", reason).withColumn("resolved_id", F.when(reason.isNull(), F.col("resolved_id")))


def last_change(changes: DataFrame, key: str, order: list[str] | None) -> DataFrame:
    """One change per key, the last by ``order``; without an order a key that is changed twice is an error."""
    rest = [c for c in changes.columns if c != key]
    if not order:
        once = changes.groupBy(key).agg(F.any_value(F.struct(*rest)).alias("_r"), F.count(F.lit(1)).alias("_n"))
        twice = F.raise_error(F.concat(F.lit("several changes of one key need an order: "), F.col(key).cast("string")))
        return once.withColumn("_r", F.when(F.col("_n") > 1, twice).otherwise(F.col("_r"))).select(key, "_r.*")
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Full rows by key: the last change of a key replaces its row or adds it."""
    changes = last_change(changes, key, order)
    c = changes.select(F.col(key).alias("_key"), F.struct(*[x for x in base.columns if x != key]).alias("_new"))
    both = base.join(c, base[key] == c["_key"], "full")
    pick = lambda x: F.when(F.col("_key").isNotNull(), F.col("_new")[x]).otherwise(F.col(x)).alias(x)
    return both.select(F.coalesce(F.col(key), F.col("_key")).alias(key), *[pick(x) for x in base.columns if x != key])


def patch(
    base: DataFrame, patches: DataFrame, key: str, stamp: Column, set_fields: str = "set_fields",
    password: str | None = None, hashed: str | None = None, order: list[str] | None = None,
) -> DataFrame:
    """Only fields named in ``set_fields`` overwrite, also with null; ``updated_at`` is stamped.

    A set ``password`` is stored as its hash in the column ``hashed`` and nowhere else. Several patches of a key
    are folded field by field in ``order``: each field has the value of the last patch that names it.
    """
    fields = [c for c in patches.columns if c not in (key, set_fields, *(order or []))]
    if order:
        named = lambda f: F.array_contains(set_fields, f)
        at = F.struct(*order)
        folded = [F.max_by(f, F.when(named(f), at)).alias(f) for f in fields]
        sets = F.filter(
            F.array(*[F.when(F.bool_or(named(f)), F.lit(f)) for f in fields]), lambda f: f.isNotNull()
        )  # flags per field, so that a key of very many patches stays one small row
        patches = patches.groupBy(key).agg(sets.alias(set_fields), *folded)
    p = patches.select(F.col(key).alias("_key"), F.col(set_fields).alias("_set"), F.struct(*fields).alias("_new"))
    both = base.join(p, base[key] == p["_key"], "left")
    given = lambda f: F.coalesce(F.array_contains("_set", f), F.lit(False))
    out = []
    for c in base.columns:
        value = F.col(c)
        if c in fields and c != password:
            value = F.when(given(c), F.col("_new")[c]).otherwise(value)
        if c == hashed and password in fields:
            value = F.when(given(password), F.sha2(F.col("_new")[password], 256)).otherwise(value)
        if c == "updated_at":
            value = F.when(F.col("_key").isNotNull(), stamp).otherwise(value)
        out.append(value.alias(c))
    return both.select(*out)


def update_where(
    base: DataFrame, changes: DataFrame, key: str, column: str, order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Base with ``column`` replaced for matching keys by their last change, and per key whether a row changed."""
    changes = last_change(changes, key, order)
    c = changes.select(F.col(key).alias("_key"), F.col(column).alias("_new"))
    both = base.join(c, base[key] == c["_key"], "left")
    value = F.when(F.col("_key").isNotNull(), F.col("_new")).otherwise(F.col(column))
    return both.select(*[value.alias(x) if x == column else F.col(x) for x in base.columns]), hits(base, changes, key)


def hits(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Per wanted key whether a row with it exists."""
    there = base.select(F.col(key).alias("_there")).distinct()
    wanted = keys.select(key).distinct()
    return wanted.join(there, wanted[key] == there["_there"], "left").select(key, F.col("_there").isNotNull().alias("changed"))


def delete_where(base: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Base without the keys, and per key whether a row went."""
    gone = keys.select(F.col(key).alias("_gone"))
    return base.join(gone, base[key] == gone["_gone"], "left_anti"), hits(base, keys, key)


def union_kinds(**kinds: DataFrame) -> DataFrame:
    """Rows of several resource kinds with their kind."""
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()])


COPIES_PER_ROW = 10_000


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Every base row n // (number of rows) times, so about n rows in all, numbered from 1.

    Many copies of few rows are made in blocks that are first spread over the tasks.
    """
    size = df.count()
    copies = n // size if size else 0
    blocks = -(-copies // COPIES_PER_ROW)
    first = F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))))
    base = df.withColumn("_block", first).filter(F.lit(copies > 0))
    if blocks > 1:
        base = base.repartition(*df.columns, "_block")
    start = F.col("_block") * COPIES_PER_ROW
    last = F.least(start + COPIES_PER_ROW, F.lit(copies))
    return base.withColumn("copy", F.explode(F.sequence(start + 1, last))).drop("_block")


def distinct_sorted(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def build_report(
    logs: DataFrame, run: str, order: list[str], title: Column, body: Column, lines_per_part: int = 200,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """All logs of a run in order, each under its title; a very long report goes on in further parts."""
    section = logs.select(run, *order, F.concat(F.lit("=== "), title, F.lit(" ===\n"), body).alias("section"))
    parts = pages_of(section, [run], order, ["section"], "sections", lines_per_part, rows_per_task)
    text = F.array_join(F.transform("sections", lambda s: s["section"]), "\n")
    return parts.select(run, F.col("page").alias("part"), F.size("sections").cast("long").alias("sections"), text.alias("report"))
