"""The operators' results by the plainest means, for small tables."""

import hashlib
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def odd_rows():
    """Null, empty, very long and repeated texts, null and repeated ids."""
    long = "Long words and numbers 12 34 go on, and on; " * 4000
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, long, "en", "a", len(long)),
        (5, "same text here and there", "en", "b", 24), (5, "same text here and there", "en", "b", 24),
        (6, "same text here and there", "fr", None, 24), (None, "no id but a text", "en", "c", 16),
        (None, None, None, None, None), (7, "é" * 300 + " ünï" * 60, "de", "c", 540), (8, "x" * 70_000, None, "c", 70_000),
    ]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def top_k(rows, is_query, k=5):
    good = [(i, [int(np.floor(256.0 * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n_q, (q, a) in enumerate(good):
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(good) if n != n_q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(prints, bits=2):
    """Least id of each row's component; prints: (id, fingerprint) of each row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(prints):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [least.get(find(i)) for i in range(len(prints))]


def repeats(texts, width=200):
    """n_bytes, n_removed, n_spans, kept of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + width] for b in raw for k in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def digest(kept):
    return hashlib.sha256(kept).hexdigest()


def packed(texts, tokenizer, width=2048):
    """(start, length, crc32) of the pieces of each text."""
    out = []
    for t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [(k, ids[k : k + width]) for k in range(0, len(ids), width)]
        out.append([(k, len(c), zlib.crc32(array("I", c).tobytes())) for k, c in cuts])
    return out


def quality_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(five)
    hit = {j for i, f in enumerate(five) if often[f] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))
