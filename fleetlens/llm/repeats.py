"""Byte strings that repeat, found by sorting suffixes that share sampled splitters.

A text is read as tokens: the 64-bit fingerprints of its 64-byte strings, one at every byte. Every window of ``width`` bytes
names one anchor, the least fingerprint inside it, so equal windows name equal anchors at the same place. Windows in a row
with one anchor form a phrase.

1. Suffixes that start at anchors are sent once for each block of documents, range-partitioned by their leading token with
   splitters from a sample. A bucket sorts them by (leading token, phrase) with multikey quicksort; equal neighbours are
   phrases that repeat whole, and phrases that share a leading token only are left open.
2. In open phrases, the suffix of every byte is sent the same way, and equal neighbours over ``width`` bytes repeat.

Splitters cut between leading tokens, so equal suffixes meet in one bucket; as a block sends equal suffixes once, a common
passage brings at most one row of each block. Suffixes count as equal when their fingerprints, 128 bits, are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.blocks import (
    carried, carry_schema, expand, expand_sorted, pack, restored, squeeze, squeeze_sorted, unpack_rows,
)
from fleetlens.llm.common import expanding, mix, stored

WIDTH = 200
TOKEN = 64
SEGMENT = 1 << 19
BUCKET_SUFFIXES = 600_000
SAMPLED = 64  # one document of so many gives splitters
SPLITTERS = 1024  # sampled splitters at most; between two, the values are divided evenly
WINDOWS = 64  # about as many windows has a phrase
NONE, WHOLE, OPEN, SEND = 0, 1, 2, 4
_K = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _K)


def multikey_sort(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their tokens, and where a row differs from the one before.

    Quicksort by one token at a time: rows that tie so far, and only they, are sorted by the next."""
    order = np.argsort(columns[0], kind="quicksort")
    ranked = columns[0][order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(order) else np.empty(0, dtype=bool)
    for column in columns[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        by = np.lexsort((column[order[at]], group))
        order[at] = order[at][by]
        values = column[order[at]]
        new[at] |= np.r_[True, (values[1:] != values[:-1]) | (group[1:] != group[:-1])]
    return order, new


def tokens(text: np.ndarray, width: int = TOKEN) -> np.ndarray:
    """The fingerprint of the ``width`` (a power of two) bytes from each place."""
    h, n = _TABLE[text], 1
    while n < width:
        h = ((h[:-n] ^ (h[:-n] >> np.uint64(29))) * _K) + h[n:]
        n *= 2
    return mix(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each place."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def segments(texts: list[bytes | None], width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts that have a window, in buffers of bounded size: bytes, and by byte the text it is of and its place there.

    A text longer than a buffer goes on in the next one, ``width - 1`` bytes before the end."""
    parts, size = [], 0

    def joined(parts):
        lengths = np.array([len(p[2]) for p in parts])
        buffer = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
        place = expanding(lengths) + np.repeat(np.array([p[1] for p in parts]), lengths)
        return buffer, np.repeat(np.array([p[0] for p in parts]), lengths), place

    for i, t in enumerate(texts):
        for at in range(0, max(len(t or b"") - width + 1, 0), SEGMENT):
            part = t[at : at + SEGMENT + width - 1]
            parts.append((i, at, part))
            size += len(part)
            if size >= SEGMENT:
                yield joined(parts)
                parts, size = [], 0
    if parts:
        yield joined(parts)


def phrases(buffer: np.ndarray, text: np.ndarray, width: int = WIDTH, token: int = TOKEN) -> dict[str, np.ndarray]:
    """The phrases of a buffer: first window, number of windows, leading token (at the anchor) and fingerprint of all."""
    n = len(buffer) - width + 1
    h = tokens(buffer, token)
    place = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    anchor = (_least(place, width - token + 1)[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    part = text[:n]
    valid = part == text[width - 1 :]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    start = np.flatnonzero(first)
    ends = np.cumsum(valid)
    count = np.diff(np.r_[ends[start] - 1, ends[-1] if len(ends) else 0])
    stop = start + count - 1 + width  # behind the last byte
    whole = mix(count.astype(np.uint64) * _K + (anchor[start] - start).astype(np.uint64))
    for k in range(0, 2 * width, token):
        at = start + k
        inside = at + token <= stop
        whole = np.where(inside, mix(whole * _K + h[np.minimum(at, len(h) - 1)]), whole)
    whole = mix(whole * _K + h[stop - token])
    return {"start": start, "count": count, "lead": h[anchor[start]], "whole": whole, "tokens": h}


def windows(h: np.ndarray, start: np.ndarray, count: np.ndarray, width: int = WIDTH, token: int = TOKEN):
    """Place, leading token and the fingerprint of the rest of every window of the phrases given."""
    at = np.repeat(start, count) + expanding(count)
    rest = h[at + (width - token)]
    for k in range(token, width - token, token):
        rest = mix(rest * _K + h[at + k])
    return at, h[at], rest


def _distinct(lead: np.ndarray, whole: np.ndarray):
    """Distinct pairs in multikey order, the pair of each row, and whether a pair comes twice or more."""
    order, new = multikey_sort([lead, whole])
    name = np.empty(len(order), dtype=np.int64)
    name[order] = np.cumsum(new) - 1
    first = order[new]
    return lead[first], whole[first], name, np.bincount(name, minlength=len(first)) > 1


def _block(texts: list[bytes | None], width: int):
    """All phrases of a block: the text, first window and number of windows of each, and the two fingerprints."""
    out = {k: [] for k in ("text", "start", "count", "lead", "whole")}
    for buffer, text, place in segments(texts, width):
        p = phrases(buffer, text, width)
        out["text"].append(text[p["start"]])
        out["start"].append(place[p["start"]])
        for k in ("count", "lead", "whole"):
            out[k].append(p[k])
    kinds = {"text": np.int64, "start": np.int64, "count": np.int64, "lead": np.uint64, "whole": np.uint64}
    return {k: np.concatenate(v) if v else np.empty(0, kinds[k]) for k, v in out.items()}


def _sent(block: int, lead: np.ndarray, whole: np.ndarray, twice: np.ndarray, splitters: np.ndarray) -> pd.DataFrame:
    cuts = np.r_[0, np.searchsorted(lead, splitters, side="right"), len(lead)]
    present = np.flatnonzero(cuts[1:] > cuts[:-1])
    rows = [
        (block, b, squeeze_sorted(lead[i:j]), squeeze(whole[i:j], np.packbits(twice[i:j])))
        for b, i, j in zip(present.tolist(), cuts[present], cuts[present + 1])
    ]
    return pd.DataFrame(rows, columns=["block", "bucket", "leads", "wholes"])


_SENT = "block long, bucket int, leads binary, wholes binary"
_ANSWER = "block long, bucket int, step int, n_open long, answer binary"


def _sort_bucket(pdf: pd.DataFrame):
    """Rows of a bucket in suffix order: by row its class, and by class its leading token's group, size and first row."""
    pdf = pdf.sort_values("block", kind="stable")
    leads = [expand_sorted(x) for x in pdf["leads"]]
    parts = [expand(x) for x in pdf["wholes"]]
    sizes = np.array([len(x) for x in leads])
    twice = np.concatenate([np.unpackbits(p[1], count=n).astype(bool) for p, n in zip(parts, sizes)])
    lead, whole = np.concatenate(leads), np.concatenate([p[0] for p in parts])
    order, new = multikey_sort([lead, whole])
    name = np.empty(len(order), dtype=np.int64)
    name[order] = np.cumsum(new) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(new))  # the earliest block that has it
    often = np.bincount(name) + np.bincount(name, weights=twice) > 1
    class_lead = lead[order[new]]
    group = np.cumsum(np.r_[True, class_lead[1:] != class_lead[:-1]]) - 1
    return pdf, np.cumsum(sizes)[:-1], name, first, often, group


def _answer_phrases(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, cuts, name, first, often, group = _sort_bucket(pdf)
    alone = np.bincount(group)[group] == 1
    some_open = np.bincount(group, weights=~often)[group] > 0
    code = np.where(often, WHOLE, np.where(alone, NONE, OPEN)).astype(np.uint8)
    rows = code[name]
    sender = first[~alone & some_open]
    rows[sender] |= SEND
    return pd.DataFrame({
        "block": pdf["block"], "bucket": pdf["bucket"], "step": 1,
        "n_open": [int((x >= OPEN).sum()) for x in np.split(rows, cuts)],
        "answer": [squeeze(x) for x in np.split(rows, cuts)],
    })


def _answer_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, cuts, name, _, often, _ = _sort_bucket(pdf)
    return pd.DataFrame({
        "block": pdf["block"], "bucket": pdf["bucket"], "step": 2, "n_open": 0,
        "answer": [squeeze(np.packbits(x), np.array([len(x)])) for x in np.split(often[name], cuts)],
    })


def _codes(answers: pd.DataFrame, name: np.ndarray) -> np.ndarray:
    got = answers[answers["step"] == 1].sort_values("bucket", kind="stable")["answer"]
    return np.concatenate([expand(x)[0] for x in got])[name] if len(got) else np.empty(0, np.uint8)


def _open_windows(texts: list[bytes | None], code: np.ndarray, width: int, wanted: int):
    """Text, place and fingerprints of the windows of phrases whose code has ``wanted``; phrases come as in _block."""
    out, at = [], 0
    for buffer, text, place in segments(texts, width):
        p = phrases(buffer, text, width)
        mine = (code[at : at + len(p["start"])] & wanted) > 0
        at += len(p["start"])
        spot, lead, rest = windows(p["tokens"], p["start"][mine], p["count"][mine], width)
        out.append((text[spot], place[spot], lead, rest, np.repeat(code[at - len(mine) : at][mine], p["count"][mine])))
    kinds = (np.int64, np.int64, np.uint64, np.uint64, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.empty(0, k) for k in kinds)


def _splitters(sample: DataFrame, step: int, suffixes: int) -> np.ndarray:
    """Cuts between leading tokens for buckets of bounded size."""
    buckets = max(8, -(-suffixes // BUCKET_SUFFIXES))
    sampled = min(buckets, SPLITTERS)
    shares = [i / sampled for i in range(1, sampled)]
    found = sample.where(F.col("step") == step).agg(F.percentile_approx("lead", shares, 10_000)).first()[0]
    cuts = [0, *sorted(x + 2**63 for x in set(found or [])), 2**64 - 1]
    parts = -(-buckets // sampled)
    fine = {a + (b - a) * i // parts for a, b in zip(cuts[:-1], cuts[1:]) for i in range(parts)} - {0}
    return np.array(sorted(fine), dtype=np.uint64)


def repeated(
    docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), width: int = WIDTH,
    as_text: bool = False,
) -> DataFrame:
    """The columns of ``carry``, n_bytes, n_removed, n_spans and kept (binary) for every row of ``docs``.

    With ``as_text``, kept is a string, without the characters that a removal cut in two.

    A byte goes if a string of ``width`` bytes that covers it also starts anywhere else in any text, the same included;
    all strings are judged on the input. Texts are UTF-8; null ones count as empty, and texts shorter than ``width``
    stay. Rows that repeat repeat each other. What stays may begin or end inside a character."""
    carry = list(carry)
    blocks = pack(docs, text, carry)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0

    def sampled(batches):
        for pdf in batches:
            for buffer, text, _ in segments([t.encode() for t in pdf["text"]], width):
                p = phrases(buffer, text, width)
                for step, lead in ((1, np.unique(p["lead"])), (2, p["tokens"][:: 4 * SAMPLED])):
                    yield pd.DataFrame({"step": step, "lead": (lead ^ np.uint64(1 << 63)).view(np.int64)})

    chosen = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64(text), F.lit(SAMPLED)) == 0)
    sample = stored(chosen.where("text is not null").mapInPandas(sampled, "step int, lead long"))
    splitters = _splitters(sample, 1, size * 2 // (width - TOKEN))

    def ask(batches):
        for pdf in batches:
            for block, rows in zip(pdf["block"], pdf["rows"]):
                p = _block(unpack_rows(rows)[1], width)
                lead, whole, _, twice = _distinct(p["lead"], p["whole"])
                yield _sent(block, lead, whole, twice, splitters)

    asked = blocks.mapInPandas(ask, _SENT)
    first = stored(asked.groupBy("bucket").applyInPandas(_answer_phrases, _ANSWER))

    n_open = first.agg(F.sum("n_open")).first()[0] or 0
    window_splitters = _splitters(sample, 2, n_open * WINDOWS)

    def ask_open(key, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(got):
            return pd.DataFrame({"block": [], "bucket": [], "leads": [], "wholes": []})
        texts = unpack_rows(rows["rows"].iloc[0])[1]
        p = _block(texts, width)
        code = _first_senders(_codes(got, _distinct(p["lead"], p["whole"])[2]), p)
        _, _, lead, rest, kind = _open_windows(texts, code, width, OPEN | SEND)
        lead, rest, _, twice = _distinct(lead, rest)
        return _sent(int(rows["block"].iloc[0]), lead, rest, twice, window_splitters)

    pairs = blocks.groupBy("block").cogroup(first.groupBy("block"))
    second = pairs.applyInPandas(ask_open, _SENT).groupBy("bucket").applyInPandas(_answer_windows, _ANSWER)
    answers = stored(first.unionByName(second))

    def cut(key, rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = ["n_bytes", "n_removed", "n_spans", "kept"]
        if not len(rows):
            return pd.DataFrame({c: [] for c in [*(f"c{i}" for i in range(len(carry))), *names]})
        others, texts = unpack_rows(rows["rows"].iloc[0])
        sizes = np.array([len(t or b"") for t in texts])
        base = np.cumsum(sizes) - sizes
        marks = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
        p = _block(texts, width)
        if len(p["start"]):
            code = _first_senders(_codes(got, _distinct(p["lead"], p["whole"])[2]), p)
            whole = (code & WHOLE) > 0
            begin = base[p["text"][whole]] + p["start"][whole]
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + p["count"][whole] - 1 + width, -1)
            text_of, place, lead, rest, kind = _open_windows(texts, code, width, OPEN | SEND)
            if len(lead):
                name = _distinct(lead, rest)[2]
                parts = got[got["step"] == 2].sort_values("bucket", kind="stable")["answer"]
                often = np.concatenate([np.unpackbits(a, count=int(n[0])) for a, n in map(expand, parts)]).astype(bool)
                hit = often[name] & ((kind & OPEN) > 0)
                begin = base[text_of[hit]] + place[hit]
                np.add.at(marks, begin, 1)
                np.add.at(marks, begin + width, -1)
        gone = np.cumsum(marks[:-1]) > 0
        out = []
        for t, b, n in zip(texts, base.tolist(), sizes.tolist()):
            mine = gone[b : b + n]
            removed = int(mine.sum())
            kept, spans = t or b"", 0
            if removed:
                kept = np.frombuffer(t, dtype=np.uint8)[~mine].tobytes()
                spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum())
            out.append((n, removed, spans, kept.decode(errors="ignore") if as_text else kept))
        return pd.DataFrame(carried(others, carry) | dict(zip(names, map(list, zip(*out)))))

    done = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        cut, carry_schema(carry) + f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"
    )
    return restored(done, docs, carry, "n_bytes", "n_removed", "n_spans", "kept")


def _first_senders(code: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Of equal phrases of a block that are to be sent, only the first is; open phrases are alone anyway."""
    send = np.flatnonzero((code & SEND) > 0)
    if len(send):
        pairs = np.stack([p["lead"][send], p["whole"][send]], axis=1)
        _, first = np.unique(pairs, axis=0, return_index=True)
        again = np.setdiff1d(np.arange(len(send)), first)
        code = code.copy()
        code[send[again]] &= ~np.uint8(SEND)
    return code


def sha256(kept: DataFrame, column: str = "kept") -> DataFrame:
    """``kept_sha256``: lower-case hexadecimal, in place of the bytes."""
    return kept.withColumn("kept_sha256", F.sha2(F.col(column), 256)).drop(column)
