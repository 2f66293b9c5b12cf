"""Row validation as rule lists; a rule is (failing condition, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Column, str]


def first_error(rules: list[Rule]) -> Column:
    """Message of the first failing rule, null when the row is valid."""
    return F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in rules])


def validate_first(df: DataFrame, rules: list[Rule], as_: str = "error") -> DataFrame:
    return df.withColumn(as_, first_error(rules))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their error."""
    checked = validate_first(df, rules)
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")


def missing_fields(required: list[str]) -> Column:
    """Names of all required fields that are null or blank, in the order given."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in required]))


def validate_all(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_fields(required)
    return df.withColumn("missing_fields", missing).withColumn(
        "error",
        F.when(F.size("missing_fields") > 0, F.concat(F.lit("Missing required fields: "), F.array_join("missing_fields", ", "))),
    )


def bounds_rules(spec: dict[str, tuple[float | None, float | None]]) -> list[Rule]:
    """Inclusive lower and upper bounds per numeric column; null is allowed."""
    rules = []
    for c, (low, high) in spec.items():
        if low is not None:
            rules.append((F.col(c) < low, f"{c} must be at least {low}"))
        if high is not None:
            rules.append((F.col(c) > high, f"{c} must be at most {high}"))
    return rules


def length_rules(spec: dict[str, tuple[int, int]]) -> list[Rule]:
    rules = []
    for c, (low, high) in spec.items():
        rules.append((F.length(c) < low, f"{c} is shorter than {low}"))
        rules.append((F.length(c) > high, f"{c} is longer than {high}"))
    return rules


def password_rules(c: str) -> list[Rule]:
    # fixed values: length range and messages
    return [
        (F.length(c) < 8, "String should have at least 8 characters"),
        (F.length(c) > 100, "String should have at most 100 characters"),
        (~F.col(c).rlike(r"\p{Nd}"), "Password must contain at least one number"),
        (~F.col(c).rlike(r"\p{L}"), "Password must contain at least one letter"),
        (~F.col(c).rlike(r"\p{Lu}"), "Password must contain at least one uppercase letter"),
        (~F.col(c).rlike(r"\p{Ll}"), "Password must contain at least one lowercase letter"),
    ]


def prefix_rule(c: str, prefix: str, message: str) -> Rule:
    return ~F.coalesce(F.col(c), F.lit("")).startswith(prefix), message
