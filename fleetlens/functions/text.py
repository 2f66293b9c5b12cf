"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: quantity suffixes
FACTORS = {
    "n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18,
    "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50, "Ei": 2.0**60,
}


def quantity(c: Column) -> Column:
    """500m, 4Gi, 1, 1e3 or 100Mi as a number; null for anything else. An exponent takes no suffix."""
    pattern = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+(?=$))?)(|n|u|m|k|M|G|T|P|E|Ki|Mi|Gi|Ti|Pi|Ei)$"
    factors = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])
    number = F.regexp_extract(c, pattern, 1).try_cast("double")
    return F.when(c.rlike(pattern), number * F.try_element_at(factors, F.regexp_extract(c, pattern, 2)))


def path_tail(c: Column, prefix: str) -> Column:
    """Last path part, for paths under the prefix only."""
    return F.when(c.startswith(prefix), F.substring_index(c, "/", -1)).otherwise(c)


def path_matches(path: Column, tail: Column) -> Column:
    return F.coalesce(path, F.lit("")).endswith(tail)


def instant(c: Column) -> Column:
    """ISO 8601 text with Z or an offset."""
    return F.to_timestamp(c)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_email(c: Column) -> Column:
    return F.coalesce(F.contains(c, F.lit("@")), F.lit(False))


def truncate(c: Column, n: int = 5000) -> Column:
    return F.substring(c, 1, n)


def preview(c: Column, n: int = 100) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def short_id(c: Column, n: int = 7) -> Column:
    return F.substring(c, 1, n)


def split_list(c: Column, separator: str = ",") -> Column:
    """Parts, trimmed, without empties."""
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def int_or(c: Column, default: int, positive: bool = False) -> Column:
    value = F.trim(c).try_cast("int")
    return F.coalesce(F.when(value > 0, value) if positive else value, F.lit(default))


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def bearer_token(c: Column) -> Column:
    """Token without its scheme, whatever the case of the scheme."""
    return F.trim(F.regexp_replace(F.trim(c), "(?i)^bearer ", ""))


def bearer_only(c: Column) -> Column:
    """Token of an Authorization header, null for any other scheme."""
    return F.when(F.lower(c).startswith("bearer "), F.trim(F.substring(c, F.lit(8), F.length(c))))


def extract_all(c: Column, field: str) -> Column:
    """All values of "field":"..." in a text."""
    return F.regexp_extract_all(c, F.lit(f'"{field}":\\s*"([^"]*)"'), F.lit(1))


def first_line(c: Column, pattern: str, default: str = "") -> Column:
    hits = F.filter(F.split(c, "\n"), lambda x: x.rlike(pattern))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(default))


def field(c: Column, n: int, separator: str | None = None) -> Column:
    """n-th field from 1: between runs of blanks, or between single separators. Empty when absent."""
    if separator is None:
        return F.coalesce(F.try_element_at(F.split(F.trim(c), r"\s+"), F.lit(n)), F.lit(""))
    return F.split_part(c, F.lit(separator), F.lit(n))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def metric_name(c: Column, prefix: str = "testapp_") -> Column:
    return F.concat(F.lit(prefix), c)


def fill(template: str, **parts: Column) -> Column:
    """Template with {name} holes."""
    pieces, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces += [F.lit(before), F.coalesce(parts[name], F.lit(""))]
    return reduce(F.concat, [*pieces, F.lit(rest)])


def service_name(c: Column, suffix: str = "-service") -> Column:
    """Name without its suffix; null where the whole name does not end in it."""
    return F.when(c.rlike(f"^(?:.*{suffix})$"), F.replace(c, F.lit(suffix), F.lit("")))
