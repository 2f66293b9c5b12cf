"""Deleted-interpolation n-gram scores of documents.

Counts cover every training document. A slice of the training documents, the deleted part, does not count for the
weights' estimation: on its n-grams, expectation-maximisation learns how to mix the maximum-likelihood estimates of all
orders and the uniform one, separately for each bucket of the context's frequency. Scores use the counts of all training
documents with these weights.

N-grams travel as 64-bit hashes (word hashes are XXH64; longer ones mix them), once for each block of documents, and their
total counts come back in the order they were sent. Two of n distinct n-grams share a hash with probability n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.blocks import (
    carried, carry_schema, expand, expand_sorted, least_type, pack, restored, squeeze, squeeze_sorted, unpack_rows,
)
from fleetlens.llm.common import mix, stored

ORDER = 2
ROUNDS = 30
LEVELS = 48  # buckets of context frequency: 0, 1, 2-3, 4-7, ...
CELLS = 8  # cells of a ratio's histogram for each power of two
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
FREE, TRAIN, DELETED = 0, 1, 2
BUCKET_GRAMS = 1_500_000
_K = np.uint64(0x9E3779B97F4A7C15)
SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
SIZES = ("tokens", "types", "kept_tokens", "kept_types")


class Grams:
    """Hashes of all n-grams of a text's tokens, for every order."""

    def __init__(self, order: int):
        self.order, self.known = order, {}

    def tokens(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts in a row, each text followed by the end, and the number of tokens of each."""
        known, out, counts = self.known, [], []
        if len(known) > 200_000:
            known.clear()
        for t in texts:
            words = t.lower().split() if t else []
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            out.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
            out.append(np.array([END]))
            counts.append(len(words) + 1)
        return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.array(counts, dtype=np.int64)

    def of(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each order, the hash of the n-gram that ends at each token (a text starts with starts), and the counts."""
        tokens, counts = self.tokens(texts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        at = np.arange(len(tokens)) - first
        grams = [mix(tokens) | np.uint64(1)]  # the lowest bit tells words from longer n-grams
        context = np.zeros(len(tokens), dtype=np.uint64)
        for n in range(2, self.order + 1):
            before = np.where(at >= n - 1, np.roll(tokens, n - 1), START)
            context = mix(context + before * _K + np.uint64(n))
            grams.append(mix(context * _K + tokens) & ~np.uint64(1))
        return grams, counts


def asked(grams: Grams, texts: list[bytes | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """N-gram keys of a block's tokens by order, how many tokens each text has, and the distinct keys, sorted."""
    keys, counts = grams.of(texts)
    return keys, counts, np.unique(np.concatenate(keys))


def _bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall into, equal ranges of the 64-bit space, and where the keys of each begin."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return of[first].astype(np.int64), first


def _ask(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """block, bucket, keys and their counts in the block (nothing for documents outside the training)."""

    def run(batches):
        grams = Grams(order)
        for pdf in batches:
            for block, kind, rows in zip(pdf["block"], pdf["kind"], pdf["rows"]):
                keys, _, distinct = asked(grams, unpack_rows(rows)[1])
                count = np.zeros(len(distinct), dtype=np.int64)
                for k in keys if kind != FREE else ():
                    u, c = np.unique(k, return_counts=True)
                    count[np.searchsorted(distinct, u)] += c
                present, first = _bucket(distinct, buckets)
                out = [
                    (block, kind, b, squeeze_sorted(distinct[i:j]), squeeze(least_type(count[i:j])))
                    for b, i, j in zip(present.tolist(), first, np.r_[first[1:], len(distinct)])
                ]
                yield pd.DataFrame(out, columns=["block", "kind", "bucket", "keys", "counts"])

    return blocks.mapInPandas(run, "block long, kind int, bucket int, keys binary, counts binary")


def _answer(questions: DataFrame) -> DataFrame:
    """For each question, the counts in all of the training (and without its deleted part, for blocks of that part).

    ``n_tokens`` and ``n_types`` add up to the words counted and the distinct ones of the training and its kept part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        keys = [expand_sorted(k) for k in pdf["keys"]]
        counts = [expand(c)[0].astype(np.int64) for c in pdf["counts"]]
        every = np.unique(np.concatenate(keys))
        total, kept = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        for k, c, kind in zip(keys, counts, pdf["kind"]):
            if kind != FREE:
                at = np.searchsorted(every, k)
                total[at] += c
                if kind == TRAIN:
                    kept[at] += c
        word = (every & np.uint64(1)).astype(bool)
        sizes = [int(x) for t in (total[word], kept[word]) for x in (t.sum(), (t > 0).sum())]
        out = []
        for block, kind, k in zip(pdf["block"], pdf["kind"], keys):
            at = np.searchsorted(every, k)
            answers = [least_type(total[at])] + ([least_type(kept[at])] if kind == DELETED else [])
            out.append((block, kind, pdf["bucket"].iloc[0], squeeze(*answers), *sizes))
            sizes = [0] * 4
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "answer", *SIZES])

    schema = "block long, kind int, bucket int, answer binary, " + ", ".join(f"{c} long" for c in SIZES)
    return questions.groupBy("bucket").applyInPandas(run, schema)


def _tallies(rows: bytes, answers: pd.DataFrame, grams: Grams):
    """Carried columns, tokens per text, and for each kind of count (all; kept) and key of a token its total."""
    others, texts = unpack_rows(rows)
    keys, counts, distinct = asked(grams, texts)
    answers = answers.sort_values("bucket", kind="stable")
    parts = [expand(a) for a in answers["answer"]]
    kinds = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(len(parts[0]))]
    at = [np.searchsorted(distinct, k) for k in keys]
    return others, counts, [[k[a] for a in at] for k in kinds]


def _level(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency."""
    return np.minimum(np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0), LEVELS - 1)


def _ratio_cell(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.floor(np.log2(np.maximum(ratio, 1e-300)) * CELLS), -(10**6)).astype(np.int64)


def estimates(
    tallies: list[np.ndarray], counts: np.ndarray, n_tokens: int, n_types: int
) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of each token (columns: uniform, unigram, bigram, ...) and how often its longest context occurs.

    ``tallies``: by order, the total of the n-gram that ends at each token. A context is the shorter n-gram that ends a
    token earlier, and at a text's first token the start, which comes as often as the end. A context never seen gives
    the estimate 0, and the weights of its bucket leave it out."""
    starts, last = np.cumsum(counts) - counts, np.cumsum(counts) - 1
    out = [np.full(len(tallies[0]), 1.0 / (n_types + 1)), tallies[0] / max(n_tokens, 1)]
    context = np.full(len(tallies[0]), n_tokens)
    for shorter, longer in zip(tallies[:-1], tallies[1:]):
        context = np.roll(shorter, 1)
        context[starts] = tallies[0][last[0]]
        out.append(longer / np.maximum(context, 1))
    return np.stack(out, axis=1), context


def learn(cells: pd.DataFrame, order: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by context bucket and order from held-out cells (level, count and the mean estimates p0, p1, ...).

    A bucket with nothing held out shares the weights of all; an order that has nothing to go by there gets none."""
    p = cells[[f"p{i}" for i in range(order + 1)]].to_numpy(dtype=float).reshape(-1, order + 1)
    count, level = cells["count"].to_numpy(dtype=float), cells["level"].to_numpy(dtype=int)

    def em(p: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = np.full(order + 1, 1.0 / (order + 1))
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * count[:, None]).sum(axis=0) / count.sum()
        w = np.maximum(w, 0) + np.eye(1, order + 1, 0)[0] * 1e-6  # the uniform estimate never goes, so no score is -inf
        return w / w.sum()

    shared = em(p, count) if len(p) else np.full(order + 1, 1.0 / (order + 1))
    out = np.tile(shared, (LEVELS, 1))
    for b in np.unique(level):
        out[b] = em(p[level == b], count[level == b])
    unseen = out[0].copy()
    if order > 1:  # contexts of frequency 0 say nothing
        unseen[order] = 0.0
        out[0] = unseen / unseen.sum()
    return out


def score(
    docs: DataFrame, trained: Column, deleted: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER,
    bucket_grams: int = BUCKET_GRAMS,
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``trained`` and ``deleted`` are conditions on ``doc_id``: documents to learn from, and those of them that the weights
    are learned on; null counts as false. Null and empty texts have one token, the end. Repeated rows count and are
    scored each. With nothing to learn from, all estimates are uniform."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = F.when(yes(trained) & yes(deleted), DELETED).when(yes(trained), TRAIN).otherwise(FREE)
    carry = [doc_id]
    blocks = pack(docs, text, carry, kind)
    total_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(8, round(total_bytes / 6 * order / bucket_grams))
    answers = stored(_answer(_ask(blocks, order, buckets)))

    sizes = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SIZES)).first().asDict()

    def cells(key, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        columns = ["level", "cell", "count", *(f"p{i}" for i in range(order + 1))]
        if not len(rows) or not len(got):
            return pd.DataFrame({c: [] for c in columns})
        _, counts, (_, kept) = _tallies(rows["rows"].iloc[0], got, Grams(order))
        p, longest = estimates(kept, counts, sizes["kept_tokens"], sizes["kept_types"])
        level = _level(longest)
        cell = np.zeros(len(p), dtype=np.uint64)
        for i in range(1, order + 1):
            cell = mix(cell * _K + _ratio_cell(p[:, i]).astype(np.uint64))
        frame = pd.DataFrame({"level": level, "cell": cell.view(np.int64), "count": 1})
        for i in range(order + 1):
            frame[f"p{i}"] = p[:, i]
        return frame.groupby(["level", "cell"], as_index=False).sum()[columns]

    columns = ", ".join(f"p{i} double" for i in range(order + 1))
    found = _with_answers(blocks.where(F.col("kind") == DELETED), answers.where(F.col("kind") == DELETED), cells,
                          f"level int, cell long, count long, {columns}")
    summed = found.groupBy("level", "cell").agg(
        F.sum("count").alias("count"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(order + 1))
    )
    held = summed.toPandas().sort_values(["level", "cell"])  # as many cells as the ratios' logarithms have
    for i in range(order + 1):
        held[f"p{i}"] /= held["count"]
    weights = learn(held, order)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def final(key, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = ["c0", *SCORES]
        if not len(rows) or not len(got):
            return pd.DataFrame({c: [] for c in names})
        others, counts, (every, *_) = _tallies(rows["rows"].iloc[0], got, Grams(order))
        n_tokens, n_types = sizes["tokens"], sizes["types"]
        p, longest = estimates(every, counts, n_tokens, n_types)
        w = shared.value[_level(longest)]
        starts = np.cumsum(counts) - counts
        c = every[0]
        base = np.log10((c + 0.1) / (n_tokens + 0.1 * (n_types + 1)))
        return pd.DataFrame({
            **carried(others, carry), "n_tokens": counts,
            "n_known": np.add.reduceat((c > 0).astype(np.int64), starts), "train_tokens": n_tokens,
            "base_score": np.add.reduceat(base, starts),
            "score": np.add.reduceat(np.log10((p * w).sum(axis=1)), starts),
        })

    scored = _with_answers(
        blocks, answers, final,
        carry_schema(carry) + "n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return restored(scored, docs, carry, *SCORES)


def _with_answers(blocks: DataFrame, answers: DataFrame, f, schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(f, schema)
