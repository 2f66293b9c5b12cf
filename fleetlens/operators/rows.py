"""Row predicates, lookups, projections, paging and ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: str, value, order: str) -> DataFrame:
    """First row with the key in insertion order; empty when there is none."""
    return df.filter(F.col(key) == value).orderBy(order).limit(1)


def lookup_many(df: DataFrame, wanted: DataFrame, key: str, order: str) -> DataFrame:
    """Batch lookup: every wanted key once, flagged ``found``, with its first row."""
    cols = [c for c in df.columns if c != key]
    first = (
        df.join(wanted.select(key).distinct(), key, "left_semi")
        .groupBy(key)
        .agg(F.min_by(F.struct(*cols), F.struct(order)).alias("r"))
    )
    return wanted.select(key).distinct().join(first, key, "left").select(key, F.col("r").isNotNull().alias("found"), "r.*")


def filter_by(df: DataFrame, **eq) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in eq.items()], F.lit(True)))


def list_page(df: DataFrame, key: str, page_size: int, token=None, where: Column | None = None) -> DataFrame:
    """One page after ``token`` with the count of all matching rows and the next token.

    The token is the last key seen, so a page costs a top-n and not a scan of all pages before it.
    """
    rows = df.filter(where) if where is not None else df
    total = rows.agg(F.count(F.lit(1))).scalar()
    after = rows.filter(F.col(key) > token) if token is not None else rows
    page = after.orderBy(key).limit(page_size).withColumn("total_count", total)
    return page.withColumn("next_token", F.max(key).over(Window.partitionBy("total_count")))  # one page


def with_total(page: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Count of the page itself and of all rows next to each row of a bounded page."""
    counted = page.withColumn("total_count", all_rows.agg(F.count(F.lit(1))).scalar())
    return counted.withColumn("page_count", F.count(F.lit(1)).over(Window.partitionBy("total_count")))


def page(df: DataFrame, order: list[str], skip: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def recent(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def recent_events(df: DataFrame, order: list[str], n: int = 30) -> DataFrame:
    """The last n rows, oldest first."""
    return recent(df, order, n).orderBy(*order)


def limit_results(df: DataFrame, order: list[str], max_results: int | None = None) -> DataFrame:
    """Default 10; from 1 to 100, else an error."""
    n = 10 if max_results is None else max_results
    # fixed values: the messages
    if n <= 0:
        raise ValueError("maxResults must be greater than 0")
    if n > 100:
        raise ValueError("maxResults cannot exceed 100")
    return df.orderBy(*order).limit(n)


def match_labels(df: DataFrame, eq: dict[str, str] | None = None, regex: dict[str, str] | None = None) -> DataFrame:
    """Matchers = and =~; a regex must match the whole value, an absent label is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    tests = [text(c) == v for c, v in (eq or {}).items()]
    tests += [text(c).rlike(f"^(?:{r})$") for c, r in (regex or {}).items()]
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def not_ready(df: DataFrame, status: str, healthy: list[str]) -> DataFrame:
    return df.filter(~F.coalesce(F.col(status).isin(*healthy), F.lit(False)))


def active_workflows(df: DataFrame, state: str, fields: list[str], active: str = "active") -> DataFrame:
    return df.filter(F.col(state) == active).select(*fields)


def public_view(df: DataFrame, hidden: list[str]) -> DataFrame:
    return df.drop(*hidden)


def age_seconds(created: str, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp"))) / 1e6


def phase_from_age(df: DataFrame, created: str, as_of: Column, phase: str, run_id: str, limits=(20, 50)) -> DataFrame:
    """Provisioning, syncing, ready by age; rows with a run or in a terminal phase keep theirs."""
    age = age_seconds(created, as_of)
    by_age = F.when(age < limits[0], "provisioning").when(age < limits[1], "syncing").otherwise("ready")
    fixed = F.col(run_id).isNotNull() | F.coalesce(F.col(phase).isin("ready", "failed"), F.lit(False))
    return df.withColumn(phase, F.when(fixed, F.col(phase)).otherwise(by_age))


def usage_over(reports: DataFrame, text: str, mount: str = "/", percent: int = 80) -> DataFrame:
    """Hosts whose disk report shows the mount point above ``percent`` used."""
    lines = reports.withColumn("_line", F.explode(F.split(text, "\n")))
    hit = lines.filter(F.regexp_extract("_line", r"(\d+)%\s+(\S+)\s*$", 2) == mount)
    used = F.regexp_extract("_line", r"(\d+)%\s+\S+\s*$", 1).cast("int")
    return hit.withColumn("used_percent", used).filter(F.col("used_percent") > percent).drop("_line", text)


def select_hosts(df: DataFrame, all_of: list[Column] = (), any_of: list[Column] = ()) -> DataFrame:
    keep = reduce(lambda a, b: a & b, all_of, F.lit(True))
    if any_of:
        keep = keep & reduce(lambda a, b: a | b, any_of)
    return df.filter(keep)


def tier_by_age(df: DataFrame, date: str, as_of: Column, cuts: list[tuple[int, str]], oldest: str) -> DataFrame:
    """Name of the first tier whose age limit in days is above the row's age."""
    age = F.datediff(as_of, F.col(date))
    tier = F.coalesce(*[F.when(age < days, F.lit(name)) for days, name in cuts], F.lit(oldest))
    return df.withColumn("age_days", age).withColumn("tier", tier)


def overdue(df: DataFrame, seconds: Column, timeout: Column, retries: Column | None = None, max_retries: int = 3) -> DataFrame:
    late = seconds > timeout
    if retries is not None:
        late = late | (retries > max_retries)
    return df.filter(late)


def route(df: DataFrame, routes: list[dict], first_only: bool = True) -> DataFrame:
    """Target queue per event: each route lists accepted values per field, an absent field accepts all."""
    hits = []
    for r in routes:
        tests = [F.col(c).isin(*vs) for c, vs in r["pattern"].items()]
        hits.append(F.when(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(r["target"])))
    if first_only:
        return df.withColumn("target", F.coalesce(*hits))
    return df.withColumn("target", F.explode(F.array_compact(F.array(*hits))))
