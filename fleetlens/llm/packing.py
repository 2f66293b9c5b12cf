"""Vector best-fit packing of tokenised documents into sequences.

Documents become token pieces of at most a sequence's length. Pieces are dealt at random into shards of bounded size, and
each shard packs its own, largest first: a sequence has residual capacities of tokens, documents and attention cost, and a
piece goes where every capacity suffices and the weighted residual is smallest (or the weighted dot product largest).
A shard of thousands of pieces wastes about as little as one packing of all, so shards never need to meet.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fleetlens.llm.common import PIECES_PER_SHARD, expanding, stored

SEQUENCE = 2048
END_ID = 0
WORDS_KEPT = 400_000  # of a task's word cache, which is emptied when full
TEXTS_AT_ONCE = 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts, word by word.

    The tokenizer drops white space and no piece of its pattern spans it, so a text's ids are those of its words in a
    row. Words repeat, so each is encoded once: words of ASCII and Latin-1 letters and signs by the tokenizer's own
    model, all others by the whole tokenizer."""

    plain = re.compile(r"[\x21-\x7eÀ-ÿ]+")
    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {"": b""}

    def _plain(self, word: str) -> bytes:
        ids = array("I")
        for piece in self.pattern.findall(word.lower()):
            if not piece.isascii():
                piece = self.byte_level.pre_tokenize_str(piece)[0][0]
            ids.extend([t.id for t in self.model.tokenize(piece)])
        return ids.tobytes()

    def _learn(self, words: list[str]) -> None:
        rest = []
        for w in words:
            if self.plain.fullmatch(w) and "<|" not in w:
                self.known[w] = self._plain(w)
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            self.known[w] = array("I", e.ids).tobytes()

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null text has none."""
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known = {"": b""}
        new = set().union(*split).difference(self.known)
        self._learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(maxsize=2)
def _words(path: str) -> WordIds:
    return WordIds(path)


def pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None,
    sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document: its ids, then ``end_id``, cut after each
    ``sequence`` ids. Null and empty texts have the end alone. Other columns of ``docs`` are not carried."""
    path = tokenizer_path or default_tokenizer()
    made = "piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL(made).fields])
    types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def run(batches):
        words, end, width = _words(path), array("I", [end_id]).tobytes(), 4 * sequence
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                few = batch.slice(at, TEXTS_AT_ONCE)
                coded = [c + end for c in words.of(few.column(1).to_pylist())]
                counts = np.array([-(-len(c) // width) for c in coded])
                part = expanding(counts)
                cuts = [c[i : i + width] for c in coded for i in range(0, len(c), width)]
                columns = [part, part * sequence, [len(c) // 4 for c in cuts], [zlib.crc32(c) for c in cuts]]
                if with_ids:
                    columns.append([np.frombuffer(c, "<u4").astype("int64") for c in cuts])
                # ids stay in Arrow: pandas would make doubles of them beside a null
                ids = few.column(0).take(pa.array(np.repeat(np.arange(len(coded)), counts)))
                arrays = [ids, *(pa.array(c, t) for c, t in zip(columns, types))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def place(
    lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Capacities and weights: tokens, documents, attention cost (length squared)."""
    demands = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1)
    if len(lengths) and (demands.max(axis=0) > capacity).any():
        raise ValueError("a piece exceeds a capacity by itself")
    cap, w = np.asarray(capacity, dtype=np.int64), np.asarray(weights, dtype=np.float64)
    left = np.empty((len(lengths), 3), dtype=np.int64)  # residuals of open bins
    name = np.empty(len(lengths), dtype=np.int64)
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    least = demands.min(axis=0) if len(lengths) else cap
    n_open = n_bins = 0
    for k, i in enumerate(np.argsort(-lengths, kind="stable")):
        d, open_ = demands[i], left[:n_open]
        fits = np.flatnonzero((open_ >= d).all(axis=1))
        if len(fits):
            share = (open_[fits] - d) / cap if rule == "norm" else open_[fits] / cap
            score = (share * share) @ w if rule == "norm" else -(share @ (w * d / cap))
            at = fits[np.argmin(score)]
        else:
            at, left[n_open], name[n_open] = n_open, cap, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i], offsets[i] = name[at], cap[0] - left[at, 0]
        left[at] -= d
        if k % 256 == 255:  # bins that can take no piece any more are closed
            stay = (left[:n_open] >= least).all(axis=1)
            n = int(stay.sum())
            left[:n], name[:n], n_open = left[:n_open][stay], name[:n_open][stay], n
    return bins, offsets


def best_fit(
    cut: DataFrame, sequence: int = SEQUENCE, max_documents: int | None = None, max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02), rule: str = "norm", per_shard: int = PIECES_PER_SHARD,
) -> DataFrame:
    """``cut`` (a ``length`` column and any others) with ``sequence_id`` and ``offset``.

    Every constraint holds in every sequence: at most ``sequence`` tokens, ``max_documents`` pieces and
    ``max_attention`` cost. The two optional ones default to what the first allows anyway. Repeated rows are packed
    each; an empty table gives an empty result."""
    capacity = (sequence, max_documents or sequence, max_attention or sequence * sequence)
    cut = stored(cut)
    shards = max(1, -(-cut.count() // per_shard))
    dealt = cut.drop("sequence_id", "offset").withColumn(
        "__shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    )
    added = T.StructType.fromDDL("sequence_id long, offset long")
    schema = T.StructType(dealt.drop("__shard").schema.fields + added.fields)

    def run(table: pa.Table) -> pa.Table:
        bins, offsets = place(table.column("length").to_numpy().astype("int64"), capacity, weights, rule)
        out = table.drop_columns("__shard")
        out = out.append_column("sequence_id", pa.array((table.column("__shard").to_numpy() << 24) + bins))
        return out.append_column("offset", pa.array(offsets))

    return dealt.groupBy("__shard").applyInArrow(run, schema)
