"""Secret scan by corpus-wide ownership: who else holds a candidate tells a copied example from a live credential.

Every text is searched with plain patterns; every candidate's value becomes a hash, and hashes are counted by distinct
repositories and owners over the whole corpus. A value that many owners hold is an example that was copied; one that a
single owner holds and that looks drawn at random is taken for live. So bare tokens, which no keyword gives away, can be
reported without reporting every long name. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

#: The kinds in the order of ties, and what they match. Keyword letters are spelled in both cases, as
#: engines differ in what else they take for the other case of k and s.
KINDS = ("assign", "access", "hex", "token")
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
VALUE = "[A-Za-z0-9+/_.=-]+"
LEAST_VALUE = 12


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = rf"""({"|".join(map(_either_case, KEYWORDS))})["']?\x20*[:=]\x20*["']?({VALUE})"""
#: Maximal runs that are long enough: the same as all runs without the short ones.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+_=-]{20,}"
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN)))

#: A hash with more than this share of all candidates is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def looks_random(value: Column) -> Column:
    """At least 3 digits, 3 letters and 10 different characters."""
    count = lambda signs: F.length(F.regexp_replace(value, f"[^{signs}]", ""))
    different = F.size(F.array_distinct(F.split(value, "")))
    return (count("0-9") >= 3) & (count("A-Za-z") >= 3) & (different >= 10)


def _pieces(text: Column, pattern: str) -> Column:
    """(gap, hit) of each match in order: the code points before it since the match before, and what it matched."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern), F.length), F.lit(1), F.size(hits))
    return F.when(text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), hits.alias("hit")))


def candidates(found: DataFrame) -> DataFrame:
    """row, owner, repository, kind (its number), start, end, value of every match that passes its kind's rule."""
    parts = []
    for k, kind in enumerate(KINDS):
        each = found.where(F.col(kind).isNotNull()).select(
            "row", "owner", "repository", F.lit(k).alias("kind"), F.posexplode(kind).alias("at", "piece")
        )
        parts.append(each.select("row", "owner", "repository", "kind", "at", "piece.gap", "piece.hit"))
    pieces = reduce(DataFrame.unionAll, parts)
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("hit")
    placed = pieces.withColumn("end", F.sum(F.col("gap") + size).over(so_far).cast("long")).withColumn(
        "value", F.when(F.col("kind") == 0, F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit"))
    )
    passes = F.when(F.col("kind") == 0, F.length("value") >= LEAST_VALUE).when(
        F.col("kind") == KINDS.index("token"), looks_random(F.col("value"))
    ).otherwise(F.lit(True))
    return placed.where(passes).select(
        "row", "owner", "repository", "kind", (F.col("end") - size).alias("start"), "end", "value"
    )


def ownership(seen: DataFrame) -> DataFrame:
    """hash, n, owners, repositories of every value hash in ``seen`` (hash, owner, repository). A null owner or
    repository counts as one more. Counted in steps, so that a hash of a third of all rows shrinks before each shuffle."""
    by_repository = seen.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(
        F.sum("n").alias("n"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories")
    )


def _with_ownership(seen: DataFrame, owned: DataFrame) -> DataFrame:
    """``seen`` with the counts of its hash. Hot hashes, at most 1 / HOT_SHARE by arithmetic, are broadcast."""
    owned = stored(owned)
    total = owned.agg(F.sum("n")).first()[0] or 0
    hot, cold = (owned.where(c).drop("n") for c in (F.col("n") > total * HOT_SHARE, F.col("n") <= total * HOT_SHARE))
    return seen.join(F.broadcast(hot), "hash").unionByName(
        seen.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(cold, "hash")
    )


def scan(
    docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text", max_owners: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id) and their spans: row, doc_id, kind, start, end, owners, repositories, verdict, base.

    ``verdict``: ``example`` if more than ``max_owners`` owners hold the value, else ``live`` if it looks random, else
    ``plain``. Spans of the kinds assign, access and hex are base and all stay; bare tokens are added where they are live
    and touch no base span of their text. Places are code points, ``end`` exclusive. Null and empty texts have no spans;
    repeated rows (and ids, null ones too) are documents of their own and no further owners; null owners are one owner.
    Other columns of ``docs`` are not read."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), owner.alias("owner"),
        repository.alias("repository"), *[_pieces(F.col(text), p).alias(k) for k, p in PATTERNS.items()],
    )
    found = stored(rows)  # a row's number is written down once, as it is no fact of the table
    seen = candidates(found).withColumn("hash", F.sha2("value", 256))
    seen = stored(seen.withColumn("random", looks_random(F.col("value"))).drop("value"))
    judged = _with_ownership(seen, ownership(seen)).withColumn(
        "verdict",
        F.when(F.col("owners") > max_owners, "example").when(F.col("random"), "live").otherwise("plain"),
    )
    token = F.col("kind") == KINDS.index("token")
    judged = judged.where(~token | (F.col("verdict") == "live"))
    # spans of a kind do not overlap, so the nearest base spans before and behind tell whether a token touches one
    so_far = (Window.unboundedPreceding, -1)
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(*so_far)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(*so_far)
    clear = (
        judged.withColumn("reached", F.max(F.when(~token, F.col("end"))).over(before))
        .withColumn("following", F.min(F.when(~token, F.col("start"))).over(behind))
        .where(
            ~token | ((F.coalesce("reached", F.lit(0)) <= F.col("start"))
                      & (F.coalesce("following", F.col("end")) >= F.col("end")))
        )
    )
    names = F.array(*map(F.lit, KINDS))
    spans = clear.select(
        "row", F.get(names, F.col("kind")).alias("kind"), F.col("kind").alias("kind_order"), "start", "end", "owners",
        "repositories", "verdict", (~token).alias("base"),
    )
    return found.select("row", "doc_id"), spans


def report(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """A row for each document: counts by kind and verdict, a digest of its base spans, and all its spans as text."""
    each = F.struct("start", "kind_order", F.concat_ws(":", "kind", "start", "end").alias("name"), "base")
    count = lambda c: F.count_if(c).alias
    summed = spans.groupBy("row").agg(
        *[count(F.col("kind") == k)(f"n_{k}") for k in KINDS],
        *[count(F.col("verdict") == v)(f"n_{v}") for v in ("live", "example")],
        F.sort_array(F.collect_list(each)).alias("each"),
    )
    named = lambda a: F.array_join(F.transform(a, lambda s: s["name"]), ",")
    counts = [f"n_{k}" for k in (*KINDS, "live", "example")]
    every = documents.join(summed, "row", "left").withColumn("base", F.filter("each", lambda s: s["base"]))
    return every.select(
        "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.sha2(F.coalesce(named("base"), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(named("each"), F.lit("")).alias("spans"),
    )
