import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import queries, repeats


def test_query(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").toPandas()
    want = {i: (*r[:3], brute.digest(r[3])) for i, r in zip(docs.doc_id, brute.repeats(docs.text))}
    got = queries.op5_suffix_array_dedup(spark, brute.SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert len(got) == len(docs) and any(w[1] for w in want.values())


def made_rows():
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcdeé ") for _ in range(n)) for n in (150, 199, 200, 201, 260, 500)]
    rows = []
    for i in range(250):
        pick = lambda: rng.choice([
            rng.choice(parts), rng.choice(parts), "x" * rng.randint(0, 300), "ab" * rng.randint(0, 150),
            str(rng.random()) * rng.randint(1, 15),
        ])
        rows.append((i, "".join(pick() for _ in range(rng.randint(0, 5)))))
    return rows + [(1000, None), (1001, ""), (None, "z" * 1000), (5, "q" * 199), (5, "q" * 200), (6, "q" * 200)]


@pytest.mark.parametrize("block", [6_000_000, 3000])
def test_made_texts_in_blocks_of_any_size(spark, monkeypatch, block):
    rows = made_rows()
    want = sorted(map(str, ((i, *r) for (i, _), r in zip(rows, brute.repeats([t for _, t in rows])))))
    pack = repeats.pack
    monkeypatch.setattr(repeats, "pack", lambda *a: pack(*a, block_bytes=block))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(5)
    got = repeats.repeated(docs).collect()
    assert sorted(str((r[0], *r[1:4], bytes(r[4]))) for r in got) == want


def test_segments_of_a_long_text_hold_every_window(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    text = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    starts = []
    for buffer, of, place in repeats.segments([b"short", None, text]):
        p = repeats.phrases(buffer, of)
        for s, n in zip(p["start"], p["count"]):
            starts += [(int(of[s]), int(place[s]) + k) for k in range(n)]
    assert sorted(starts) == [(2, i) for i in range(5000 - 199)]


def test_multikey_sort():
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order, new = repeats.multikey_sort(columns)
    rows = list(zip(*(c[order].tolist() for c in columns)))
    assert rows == sorted(rows)
    assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))]


def test_empty(spark):
    assert repeats.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in repeats.repeated(nothing).collect()) == [(1, 0, 0, 0), (2, 5, 0, 0)]


def test_carried_columns_keep_their_types(spark):
    docs = spark.createDataFrame(brute.odd_rows(), brute.COLUMNS)
    got = repeats.repeated(docs, carry=("doc_id", "lang", "n_chars"))
    assert [f.dataType.simpleString() for f in got.schema][:3] == ["bigint", "string", "bigint"]
    assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(str((r[0], r[2], r[4])) for r in brute.odd_rows())
