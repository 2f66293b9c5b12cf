"""File sinks and sources: Parquet results, reports, tenant layout, object dumps, scrapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.segments import ROWS_PER_TASK, bounded_broadcast, large_keys


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sample_results(spark: SparkSession, path: str, n: int, key: list[str]) -> DataFrame:
    """First rows of a written result, ordered so that the sample can be repeated."""
    return spark.read.parquet(path).orderBy(*key).limit(n)


def report_lines(df: DataFrame, cols: list[str], title: str, as_of: str) -> DataFrame:
    """Report as (section, line): head, one line per row, total."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols]), F.lit(" |"))
    rows = df.select(F.lit(1).alias("section"), cells.alias("line"))
    # fixed values: the report's headings, here and in the total
    titles = F.array(F.lit(title), F.lit(f"Last Updated: {as_of}"), F.lit("|| " + " || ".join(cols) + " ||"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("section"), F.explode(titles).alias("line"))
    total = df.groupBy().count().select(
        F.lit(2).alias("section"), F.concat(F.lit("Total images found: "), F.col("count")).alias("line")
    )
    return head.unionByName(rows).unionByName(total)


def write_report(df: DataFrame, path: str, cols: list[str], title: str, as_of: str) -> None:
    lines = report_lines(df, cols, title, as_of)
    lines.orderBy("section", "line").select("line").write.mode("overwrite").text(path)


def write_tenant_partitioned(
    df: DataFrame, path: str, tenant: str, spread: list[str], rows_per_file: int = ROWS_PER_TASK
) -> None:
    """One folder per tenant. A large tenant is written by as many tasks as it needs files, a small one by one."""
    large, _ = large_keys(df, [tenant], rows_per_file)
    field = df.schema[tenant].dataType.simpleString()
    sizes = df.sparkSession.createDataFrame(
        [(r[tenant], -(-r["_n"] // rows_per_file)) for r in large], f"_tenant {field}, _files long"
    )
    marked = df.join(bounded_broadcast(sizes, len(large)), F.col(tenant).eqNullSafe(F.col("_tenant")), "left")
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("_files", F.lit(1)))
    rows = marked.repartition(F.col(tenant), salt).drop("_tenant", "_files")
    rows.write.mode("overwrite").partitionBy(tenant).parquet(path)


# fixed values: signs that a partition folder's name escapes, and the folder of rows without a tenant
_ESCAPED = set('"#%\'*/:=?\\{[]^\x7f') | {chr(c) for c in range(1, 32)}
_NO_TENANT = "__HIVE_DEFAULT_PARTITION__"


def tenant_folder(path: str, tenant: str, value) -> str:
    name = lambda s: "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in s)
    return f"{path}/{name(tenant)}={_NO_TENANT if value in (None, '') else name(str(value))}"


def read_tenant(spark: SparkSession, path: str, tenant: str, value, tenant_type: str = "string") -> DataFrame:
    """Reads the tenant's folder and no other; an unknown tenant raises as a path that isn't there.

    The value is not read back from the folder's name, so "0012" and "12" stay two tenants of text type."""
    # taken as the data's base path, the folder's own name adds no column of an inferred type
    folder = tenant_folder(path, tenant, value)
    rows = spark.read.option("basePath", folder).parquet(folder)
    return rows.withColumn(tenant, F.lit(value).cast(tenant_type))


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """One read of the stream, written to every sink."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


OBJECT_SCHEMA = """
kind string,
metadata struct<name: string, namespace: string, labels: map<string,string>, creationTimestamp: timestamp>,
spec struct<
  containers: array<struct<name: string, image: string,
    resources: struct<requests: map<string,string>, limits: map<string,string>>>>,
  template: struct<spec: struct<containers: array<struct<name: string, image: string,
    resources: struct<requests: map<string,string>, limits: map<string,string>>>>>>,
  rules: array<struct<host: string>>>,
status struct<phase: string,
  conditions: array<struct<type: string, status: string, lastTransitionTime: timestamp>>,
  containerStatuses: array<struct<name: string, ready: boolean, restartCount: int>>,
  capacity: map<string,string>>
"""


def read_objects(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Cluster objects, one JSON document per line; broken lines keep null fields."""
    df = spark.read.schema(OBJECT_SCHEMA).json(path)
    return df.filter(F.lower("kind") == kind.lower()) if kind else df


def _escaped(c: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def _unescaped(c: Column) -> Column:
    """A backslash pair is set aside first, so that what follows it isn't taken for an escape."""
    aside = "\ufffe"
    for written, plain in (("\\\\", aside), ('\\"', '"'), ("\\n", "\n"), (aside, "\\")):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def _labels(labels: str) -> Column:
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"'))
    )
    return F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")


def to_exposition(samples: DataFrame) -> DataFrame:
    """(name, labels, value) as one text line per series, labels sorted by name, their values escaped."""
    labels = F.coalesce(_labels("labels"), F.lit(""))
    return samples.select(F.concat(F.col("name"), labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


# fixed values: shape of an exposition line
_LINE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(\d+))?$"
_PAIR = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def _names(text: str) -> Column:
    return F.regexp_extract_all(F.regexp_extract(text, _LINE, 2), F.lit(_PAIR), F.lit(1))


def _values(text: str) -> Column:
    found = F.regexp_extract_all(F.regexp_extract(text, _LINE, 2), F.lit(_PAIR), F.lit(2))
    return F.transform(found, _unescaped)


def _silent(text: str) -> Column:
    line = F.trim(F.coalesce(F.col(text), F.lit("")))
    return (line == "") | line.startswith("#")


def _fault(text: str) -> Column:
    number = F.lower(F.regexp_extract(text, _LINE, 3))
    named = number.isin("nan", "inf", "+inf", "-inf")
    return (
        F.when(~F.col(text).rlike(_LINE), "shape")
        .when(F.size(F.array_distinct(_names(text))) < F.size(_names(text)), "repeated label")
        .when(F.regexp_extract(text, _LINE, 3).try_cast("double").isNull() & ~named, "value")
        .otherwise("")
    )


def broken_scrapes(lines: DataFrame, text: str = "value") -> DataFrame:
    """The lines that are no samples, with what is wrong with them: shape, repeated label or value."""
    return lines.filter(~_silent(text) & (_fault(text) != "")).select(F.col(text).alias("line"), _fault(text).alias("fault"))


def ingest_scrapes(lines: DataFrame, text: str = "value", ts: Column | None = None) -> DataFrame:
    """Samples from exposition text. Comments and empty lines say nothing; ``broken_scrapes`` has the broken ones."""
    own = F.timestamp_millis(F.nullif(F.regexp_extract(text, _LINE, 4), F.lit("")).cast("long"))
    good = lines.filter(~_silent(text) & (_fault(text) == ""))
    # a filter may run after a projection, so the map itself keeps the last value of a repeated name
    pairs = F.arrays_zip(_names(text).alias("k"), _values(text).alias("v"))
    labels = F.map_from_entries(
        F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(_names(text), i + 2, F.size(pairs)), p["k"]))
    )
    return good.select(
        F.regexp_extract(text, _LINE, 1).alias("name"),
        labels.alias("labels"),
        F.coalesce(own, ts if ts is not None else F.lit(None).cast("timestamp")).alias("ts"),
        F.regexp_extract(text, _LINE, 3).try_cast("double").alias("value"),
    )


def alert_record(name: str, severity: str, namespace: str, metrics: list[str]) -> Column:
    """Nested alert document from the columns timestamp, service_name and the metrics."""
    alert = F.struct(
        F.lit(name).alias("name"),
        F.col("timestamp"),
        F.lit(severity).alias("severity"),
        F.lit(namespace).alias("namespace"),
        F.col("service_name"),
        F.struct(*[F.col(m) for m in metrics]).alias("metrics"),
    )
    return F.to_json(F.struct(alert.alias("alert")))
