"""Signatures, keys and derived names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def job_signature(prompt, job_type, payload, parameters=None, delimited: bool = False) -> Column:
    """SHA-256 over prompt, type, payload and the key-sorted parameters.

    The parts are joined without separators, so different splits of the same
    text collide; ``delimited=True`` hashes a length before each part instead.
    """
    parts = [_text(prompt), _text(job_type), _text(payload)]
    mark = (lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)) if delimited else (lambda c: c)
    body = F.concat(*[mark(p) for p in parts])
    if parameters is not None:
        m = F.col(parameters) if isinstance(parameters, str) else parameters
        pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(mark(e["key"]), mark(e["value"])))
        body = F.concat(body, F.coalesce(F.array_join(pairs, ""), F.lit("")))
    return F.sha2(body, 256)


def lock_key(org, job_type, signature) -> Column:
    return F.concat_ws(":", F.lit("mcp:job"), _text(org), _text(job_type), signature)  # fixed value: key format


def throttle_key(org, window: str) -> Column:
    return F.concat_ws(":", F.lit("throttle"), _text(org), F.lit(window))  # fixed value: key format


def tenant_namespace(org) -> Column:
    return F.concat(F.lit("tenant-"), _text(org))


def tenant_role(org) -> Column:
    return F.concat(F.lit("tenant-"), _text(org), F.lit("-role"))


def tenant_prefix(org) -> Column:
    return F.concat(F.lit("orgs/"), _text(org))


def random_id() -> Column:
    """Fresh on every evaluation; use ``stable_id`` where a retry must agree."""
    return F.uuid()


def stable_id(*cols) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)
