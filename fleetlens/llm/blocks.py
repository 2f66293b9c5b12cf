"""Blocks: documents packed into compressed rows that one task reads at a time, and answers sent back to them.

A block is a few thousand documents of one input partition. It asks buckets about what its texts hold (n-grams, suffixes)
with sorted, compressed arrays instead of a row for each, and gets its answers in the order it asked.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

BLOCK_BYTES = 4_000_000


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, each with its type and length."""
    out = []
    for a in arrays:
        out += [a.dtype.str.encode().ljust(4), np.int64(len(a)).tobytes(), a.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def expand(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(blob))
    out, at = [], 0
    while at < len(raw):
        dtype, n = np.dtype(raw[at : at + 4].decode().strip()), int(np.frombuffer(raw, "<i8", 1, at + 4)[0])
        out.append(np.frombuffer(raw, dtype, n, at + 12))
        at += 12 + n * dtype.itemsize
    return out


def least_type(a: np.ndarray) -> np.ndarray:
    """Non-negative whole numbers in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as byte planes of their differences, which compress better."""
    steps = np.diff(values, prepend=np.uint64(0))
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).ravel())


def expand_sorted(blob: bytes) -> np.ndarray:
    planes = expand(blob)[0].reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack(
    docs: DataFrame, text: str = "text", carry: list[str] | None = None, kind: Column | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """block long, kind int, rows binary: texts with the columns of ``carry``, written once to shared storage.

    Rows of unlike ``kind`` (a small number) are never in one block. A block's name is a fact of the written table, so it
    stays the same for every later pass, however that is partitioned."""
    kind = F.lit(0) if kind is None else kind
    carry = carry or []
    names, types = ["block", "kind", "rows"], [pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        part = TaskContext.get().partitionId()
        open_: dict[int, list] = {}
        sizes: dict[int, int] = {}
        made = 0

        def close(k: int):
            nonlocal made
            others, texts = zip(*open_.pop(k))
            sizes.pop(k)
            made += 1
            row = [[(part << 24) + made], [k], [pack_rows(others, texts)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names)

        # Arrow values one by one: a batch is never held as Python objects
        for batch in batches:
            for i in range(batch.num_rows):
                k, t, *o = (column[i].as_py() for column in batch.columns)
                raw = t.encode() if t is not None else None
                open_.setdefault(k, []).append((o, raw))
                sizes[k] = sizes.get(k, 0) + len(raw or b"") + 64
                if sizes[k] >= block_bytes:
                    yield close(k)
        for k in sorted(open_):
            yield close(k)

    others = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(kind.cast("int").alias("kind"), F.col(text).alias("text"), *others)
    return stored(rows.mapInArrow(run, "block long, kind int, rows binary"))


def pack_rows(others, texts) -> bytes:
    null = np.array([t is None for t in texts], dtype=np.uint8)
    sizes = np.array([len(t or b"") for t in texts], dtype=np.int64)
    carried = np.frombuffer(json.dumps(others).encode(), dtype=np.uint8)
    return squeeze(null, sizes, np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8), carried)


def unpack_rows(blob: bytes) -> tuple[list[list[str | None]], list[bytes | None]]:
    """The carried columns as strings, and the texts."""
    null, sizes, text, carried = expand(blob)
    text, ends = text.tobytes(), np.cumsum(sizes)
    texts = [None if n else text[e - s : e] for e, s, n in zip(ends.tolist(), sizes.tolist(), null)]
    return json.loads(carried.tobytes()), texts


def carried(others: list[list[str | None]], carry: list[str]) -> dict[str, list]:
    return {f"c{i}": [o[i] for o in others] for i in range(len(carry))}


def carry_schema(carry: list[str]) -> str:
    return "".join(f"c{i} string, " for i in range(len(carry)))


def restored(df: DataFrame, docs: DataFrame, carry: list[str], *more: str) -> DataFrame:
    """The carried columns under their names and types, then ``more``."""
    own = [F.col(f"c{i}").cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(carry)]
    return df.select(*own, *more)
