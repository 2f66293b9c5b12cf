"""SimHash near-duplicates found through tables of distances to reference fingerprints.

Documents of one fingerprint are one class, so links are sought between distinct fingerprints only. The references are the
empty fingerprint, one that has the bits of block b for each block of two bits, and a fixed random set. Distances to the
structured references place a fingerprint: two within ``max_bits`` agree in all but ``max_bits`` of the blocks' distances,
so of five groups of blocks they agree in at least ``5 - max_bits``, and every choice of so many groups makes a key under
which they meet. Under a key, pairs go whose distances to any reference differ by more than ``max_bits`` and the bits of the
rest are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import mix, stored, words_of
from fleetlens.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
BLOCK = 2
PIVOTS = 16  # random references beside the structured ones
ALL_PAIRS = 2048  # distinct fingerprints under a key that are compared by the tables; more are probed by flipped bits
_BATCH = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit i is set if over half the shingles' XXH64 values (seed 42) have it. No words: 0."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist())
    counts, total = np.zeros(64, dtype=np.int64), 0
    spans = list(spans)
    for at in range(0, n, _BATCH):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[at : at + _BATCH]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view("<u8")[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def block_distances(x: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Distances to the structured references less the distance to the empty one: one column for each block."""
    starts = np.arange(0, 64, block, dtype=np.uint64)
    masks = (np.uint64(2**block - 1) << starts)[None, :]
    return np.bitwise_count(x[:, None] ^ masks).astype(np.int16) - np.bitwise_count(x).astype(np.int16)[:, None]


def keys(x: np.ndarray, max_bits: int = MAX_BITS, block: int = BLOCK) -> np.ndarray:
    """Keys of each fingerprint, one column for each choice of groups that may agree."""
    groups = max_bits + 3
    table = (block_distances(x, block) + block).astype(np.uint64)
    member = np.arange(table.shape[1]) % groups
    out = []
    for c, chosen in enumerate(combinations(range(groups), groups - max_bits)):
        key = np.full(len(x), c + 1, dtype=np.uint64)
        for j in np.flatnonzero(np.isin(member, chosen)):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, j])
        out.append(key)
    return signed(np.stack(out, axis=1))


def references(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, size=n, dtype=np.uint64)


def near_pairs(x: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of distinct fingerprints within ``max_bits``: all of them for few, spanning links for many."""
    n = len(x)
    left, right = [], []
    if n <= ALL_PAIRS:
        pivots = references()
        table = np.bitwise_count(x[:, None] ^ pivots[None, :]).astype(np.int16)
        step = max(1, 4_000_000 // max(n, 1))
        for at in range(0, n, step):
            i, j = np.nonzero(np.abs(table[at : at + step, None, 0] - table[None, :, 0]) <= max_bits)
            i += at
            i, j = i[i < j], j[i < j]
            for p in range(1, len(pivots)):  # the largest coordinate difference decides
                ok = np.abs(table[i, p] - table[j, p]) <= max_bits
                i, j = i[ok], j[ok]
            ok = np.bitwise_count(x[i] ^ x[j]) <= max_bits
            left.append(i[ok])
            right.append(j[ok])
    else:
        order = np.argsort(x, kind="stable")
        ranked = x[order]
        for count in range(1, max_bits + 1):
            for bits in combinations(range(64), count):
                flip = np.uint64(sum(1 << b for b in bits))
                at = np.minimum(np.searchsorted(ranked, ranked ^ flip), n - 1)
                hit = np.flatnonzero((ranked[at] == ranked ^ flip) & (ranked < ranked ^ flip))
                left.append(order[hit])
                right.append(order[at[hit]])
    i, j = np.concatenate(left), np.concatenate(right)
    return np.minimum(i, j), np.maximum(i, j)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place that has a link, with the least place it is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            member = np.flatnonzero(root != np.arange(n))
            return member, root[member]
        root = new


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(signed(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)))

    return docs.withColumn(name, of(F.col(text)))


def fingerprint_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, root: fingerprints that have a near one, with the representative of their component.

    Within a key only links that keep it connected are made, at most one for each fingerprint."""

    def spread(batches):
        for pdf in batches:
            x = pdf["fp"].to_numpy().view(np.uint64)
            k = keys(x, max_bits)
            yield pd.DataFrame({"key": k.ravel(), "fp": np.repeat(pdf["fp"].to_numpy(), k.shape[1])})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(pdf["fp"].to_numpy())
        member, root = spanning(len(values), *near_pairs(values.view(np.uint64), max_bits))
        return pd.DataFrame({"a": values[member], "b": values[root]})

    met = prints.select("fp").distinct().mapInPandas(spread, "key long, fp long")
    # keys with one fingerprint need no Python: count first, combined before the shuffle
    size = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    links = met.join(size, "key", "left_semi").groupBy("key").applyInPandas(link, "a long, b long")
    return components(links).select(F.col("node").alias("fp"), "root")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """doc_id, fp, component_id: the least id of all documents reachable over fingerprints within ``max_bits``.

    Null and empty texts have fingerprint 0, which links like any other. Repeated ids give a row each. Rows without an
    id have a class by their text but never name it; a class of such rows only has a null component."""
    prints = stored(
        fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle)
        .select("doc_id", "fp")
    )
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = classes.join(fingerprint_components(classes, max_bits), "fp", "left")
    roots = stored(roots.select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
