"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its words and word pairs, the shapes of words (``THE!!`` is ``A!``) in runs of one to three, and
word triples seen before in the text, each hashed to a slot and weighed by its share of the text. Training shards of a
bounded labelled sample run in parallel, each with per-coordinate FTRL-Proximal; their weights are averaged. Scoring is a
sparse dot product.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import mix

BITS = 18
SAMPLE = 16_384  # labelled texts a model is fitted on at most
SHARDS = 8
WORDS_KEPT = 150_000
SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))
REPEAT = re.compile(rb"(.)\1+")


class Features:
    """Slots and values of a text; word hashes are cached by task."""

    def __init__(self, bits: int = BITS):
        self.shift, self.words = np.uint64(64 - bits), {}

    def _hash(self, word: bytes) -> tuple[int, int]:
        shape = word
        for pattern, kind in SHAPES:
            shape = pattern.sub(kind, shape)
        pair = xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(REPEAT.sub(rb"\1", shape), 1)
        self.words[word] = pair
        return pair

    def __call__(self, text: str | None) -> tuple[np.ndarray, float]:
        """Slots, one for each occurrence, and the value each occurrence adds."""
        words = text.encode().split() if text else []
        if not words:
            return np.empty(0, dtype=np.int64), 0.0
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        known, learn = self.words, self._hash
        pairs = np.array([known.get(w) or learn(w) for w in words], dtype=np.uint64)
        w, s = pairs[:, 0], pairs[:, 1]
        k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        two, shape2 = w[:-1] * k1 + w[1:], s[:-1] * k1 + s[1:]
        three, shape3 = two[:-1] * k2 + w[2:], shape2[:-1] * k2 + s[2:]
        again = np.full(len(three) - len(np.unique(three)), k3)
        slots = np.concatenate([w, two * k3, s, shape2 * k3, shape3, again])
        return (mix(slots) >> self.shift).astype(np.int64), 1.0 / len(words)


@dataclass
class Ftrl:
    """Per-coordinate FTRL-Proximal for logistic loss (McMahan et al. 2013)."""

    bits: int = BITS
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    epochs: int = 4

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def fit(self, texts: list[str | None], labels: np.ndarray, seed: int = 0) -> np.ndarray:
        """Weights of all slots; the last is the bias."""
        features, size = Features(self.bits), 1 << self.bits
        rows = []
        for t in texts:
            slots, value = features(t)
            at, count = np.unique(slots, return_counts=True)
            rows.append((np.append(at, size), np.append(count * value, 1.0)))
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        order = np.random.default_rng(seed)
        for _ in range(self.epochs):
            for i in order.permutation(len(rows)):
                at, x = rows[i]
                w = self.weights(z[at], n[at])
                g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - labels[i]) * x
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / self.alpha
                z[at] += g - sigma * w
                n[at] += g * g
        return self.weights(z, n)


def sample_of(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, text: str = "text", size: int = SAMPLE
) -> DataFrame:
    """doc_id, text, label: at most ``size`` labelled ids (label not null), chosen by a hash of the id, with their texts.

    An id labelled twice alike counts once, an id with two labels not at all."""
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed)
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other").select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )
    # at most ``size`` ids and labels, so the texts need not move to find theirs
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")


def train(sample: DataFrame, text: str = "text", shards: int = SHARDS, ftrl: Ftrl | None = None) -> np.ndarray:
    """Weights from ``sample`` (``text`` and ``label`` 0 or 1), averaged over the shards; without rows all 0.

    What comes back to the driver is one number for each slot."""
    ftrl = ftrl or Ftrl()

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order", kind="stable")
        w = ftrl.fit(pdf["text"].tolist(), pdf["label"].to_numpy(dtype=float), seed=int(key[0]))
        at = np.flatnonzero(w)
        return pd.DataFrame({"shard": int(key[0]), "slot": at, "weight": w[at]})

    order = F.xxhash64(text, "label")
    parts = (
        sample.select(F.col(text).alias("text"), F.col("label").cast("int").alias("label"), order.alias("order"))
        .withColumn("shard", F.pmod(F.xxhash64("order"), F.lit(shards)))
        .groupBy("shard").applyInPandas(fit, "shard int, slot long, weight double")
    )
    used = parts.groupBy("slot").agg(F.sort_array(F.collect_list("weight")).alias("weights"))
    total = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    found = used.select("slot", (total / shards).alias("weight")).toPandas()
    weights = np.zeros((1 << ftrl.bits) + 1)
    weights[found["slot"].to_numpy()] = found["weight"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1. Null and empty texts get the bias's. A column ``name`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # one number for each slot, whatever the input
    bits = int(len(weights) - 1).bit_length() - 1

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        w, features = shared.value, Features(bits)
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            slots, value = features(t)
            out[i] = w[-1] + w[slots].sum() * value
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn(name, probability(F.col(text)))
