"""Token counts by overlap resynchronisation.

A long text is cut into chunks that overlap. Every chunk is encoded by itself, in its own task, and keeps the byte
offsets of its tokens. Two neighbours are spliced at a boundary both of them have inside their overlap and that holds
whatever comes before: the pattern of the tokenizer can't run across it. Where an overlap has no such boundary, it is
widened and only those chunks are encoded again, until they meet or reach the end of the text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

CHUNK = 16_384
OVERLAP = 256
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def _encoding(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}
    )
    sizes = np.zeros(max(max(ranks.values()), SPECIAL_ID) + 1, dtype=np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    sizes[SPECIAL_ID] = len(SPECIAL)
    return encoding, sizes


def encode(text: str, ranks_path: str) -> list[int]:
    """Token ids; the special string is one token, as the tokenizer's default has it."""
    return _encoding(ranks_path)[0].encode(text, allowed_special="all", disallowed_special=())


#: A boundary after which the pattern starts anew, whatever stands before: a word, number or sign is followed by white
#: space, a letter by a digit or sign, a digit by a letter or sign. A sign before a letter is none (contractions), and
#: white space before anything is none (one space joins the next word). The special string is kept out by the test
#: that both encodings have a token boundary there.
def _stable(text: str) -> np.ndarray:
    """Places (in code points) of the boundaries in ``text`` that hold in any context."""
    import regex

    kinds = np.zeros(len(text), dtype=np.int8)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"[^\s\p{L}\p{N}]+")):
        for m in regex.finditer(pattern, text):
            kinds[m.start() : m.end()] = kind
    a, b = kinds[:-1], kinds[1:]
    return np.flatnonzero((a != 0) & (a != b) & ~((a == 3) & (b != 0))) + 1


def _edges(text: str, first: int, ends: np.ndarray, low: int, high: int) -> tuple[list[int], list[int]]:
    """Stable token boundaries of a chunk within the bytes [low, high) of the document, and the tokens before each."""
    own = text.encode()
    a, b = max(0, low - first), min(len(own), high - first)
    if a >= b:
        return [], []
    while a > 0 and own[a] & 0xC0 == 0x80:
        a -= 1
    part = own[a:b].decode(errors="ignore")
    byte_at = np.cumsum([0, *(len(c.encode()) for c in part)]) + a
    places = byte_at[_stable(part)]
    at = np.searchsorted(ends, places)
    good = (at < len(ends)) & (ends[np.minimum(at, len(ends) - 1)] == places)
    return (places[good] + first).tolist(), (at[good] + 1).tolist()


_PART = "row_id long, chunk int, first long, own_end long, overlap int, text string"
_CODED = (
    "row_id long, chunk int, n_tokens long, head_at array<long>, head_count array<long>, "
    "tail_at array<long>, tail_count array<long>"
)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """A row for each chunk, with the overlap behind it, dealt out evenly."""

    def run(batches):
        for pdf in batches:
            for row_id, text in zip(pdf.row_id, pdf.text):
                rows, first = [], 0
                for i, start in enumerate(range(0, len(text), chunk)):
                    end = first + len(text[start : start + chunk].encode())
                    rows.append((row_id, i, first, end, overlap, text[start : start + chunk + overlap]))
                    first = end
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=_names(_PART))
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_names(_PART))

    return texts.mapInPandas(run, _PART).repartition("row_id", "chunk")


def _encode_chunks(rows: DataFrame, ranks_path: str) -> DataFrame:
    """Encode each chunk; keep its count and the boundaries in the overlaps before and behind."""

    def run(batches):
        _, sizes = _encoding(ranks_path)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ends = np.cumsum(sizes[encode(r.text, ranks_path)])
                head = _edges(r.text, r.first, ends, r.first, r.first + 4 * r.overlap)
                tail = _edges(r.text, r.first, ends, r.own_end, r.own_end + 4 * r.overlap)
                out.append((r.row_id, r.chunk, len(ends), *head, *tail))
            yield pd.DataFrame(out, columns=_names(_CODED))

    return rows.mapInPandas(run, _CODED)


def _meet(a_at, a_count, b_at, b_count) -> tuple[int, int]:
    """The first boundary both chunks have: tokens of the left before it, and of the right; (-1, -1): none."""
    right = dict(zip(b_at, b_count))
    return next(((int(n), int(right[p])) for p, n in zip(a_at, a_count) if p in right), (-1, -1))


def _spliced(texts: DataFrame, ranks_path: str, chunk: int, overlap: int) -> DataFrame:
    """row_id and n_tokens of texts longer than a chunk."""

    @F.pandas_udf("left long, right long")
    def meet(a_at: pd.Series, a_count: pd.Series, b_at: pd.Series, b_count: pd.Series) -> pd.DataFrame:
        found = [(None, None) if d is None else _meet(a, b, c, d) for a, b, c, d in zip(a_at, a_count, b_at, b_count)]
        return pd.DataFrame(found, columns=["left", "right"]).astype("Int64")

    order = Window.partitionBy("row_id").orderBy("chunk")
    done = None
    while True:
        coded = _encode_chunks(_cut(texts, chunk, overlap), ranks_path)
        met = coded.withColumns(
            {"b_at": F.lead("head_at").over(order), "b_count": F.lead("head_count").over(order)}
        ).withColumn("met", meet("tail_at", "tail_count", "b_at", "b_count"))
        own = F.coalesce("met.left", "n_tokens") - F.coalesce(F.lag("met.right").over(order), F.lit(0))
        per_text = stored(
            met.select("row_id", own.alias("own"), (F.col("met.left") == -1).alias("apart"))
            .groupBy("row_id")
            .agg(F.sum("own").alias("n_tokens"), F.coalesce(F.bool_or("apart"), F.lit(False)).alias("apart"))
        )
        new = per_text.where(~F.col("apart")).select("row_id", "n_tokens")
        done = new if done is None else done.unionByName(new)
        apart = per_text.where("apart").select("row_id")
        if apart.isEmpty():
            return done
        # some chunks share no boundary: only their texts again, with wider overlaps
        texts, overlap = texts.join(apart, "row_id"), overlap * 8
        chunk = max(chunk, 8 * overlap)


def count_tokens(
    docs: DataFrame, text: str = "text", ranks_path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens``.

    Null and empty texts have 0 tokens. Repeated rows are counted each. Columns of ``docs`` named like the two results
    are replaced. ``chunk`` and ``overlap`` are in code points and change only how the work is divided."""
    ranks_path, overlap = ranks_path or default_ranks(), max(overlap, 2 * len(SPECIAL))
    chunk = max(chunk, 8 * overlap)
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    docs = docs.select(*keep)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

    @F.pandas_udf("long")
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t, ranks_path)) if t else 0).astype("int64")

    long = F.coalesce(F.length(text), F.lit(0)) > chunk
    small = docs.where(~long).withColumns({"n_bytes": size, "n_tokens": whole(F.col(text))})
    # each long row gets a name; stored, so that every pass sees the same one
    huge = stored(docs.where(long).withColumn("__row", F.monotonically_increasing_id()))
    done = _spliced(huge.select(F.col("__row").alias("row_id"), F.col(text).alias("text")), ranks_path, chunk, overlap)
    counted = huge.join(done.withColumnRenamed("row_id", "__row"), "__row").withColumn("n_bytes", size)
    return small.unionByName(counted.select(*keep, "n_bytes", "n_tokens"))
