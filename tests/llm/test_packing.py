from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(got, limit=2048):
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["length"].sum() <= limit
        assert g["offset"].tolist() == np.cumsum([0, *g["length"]])[:-1].tolist()


def test_query(spark, tokenizer):
    got = queries.op3_best_fit_packing(spark, brute.SF).toPandas()
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").toPandas()
    want = {
        (i, k): p for i, ps in zip(docs.doc_id, brute.packed(docs.text, tokenizer)) for k, p in enumerate(ps)
    }
    have = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()}
    assert have == want and len(got) == len(want)
    check(got)
    assert got.sequence_id.nunique() <= 1.01 * np.ceil(got["length"].sum() / 2048) + 1


def test_odd_rows_and_clashing_columns(spark, tokenizer):
    rows = brute.odd_rows()
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], brute.COLUMNS + ", piece string, offset int")
    got = packing.best_fit(packing.pieces(docs, with_ids=True)).toPandas()
    want = sorted(p for ps in brute.packed([r[1] for r in rows], tokenizer) for p in ps)
    assert sorted(zip(got.start, got.length, got.ids_crc32)) == want
    assert [len(x) for x in got.ids] == got["length"].tolist()
    check(got)
    empty = docs.where("false")
    assert packing.best_fit(packing.pieces(empty)).count() == 0


def test_words_alone_give_the_ids_of_the_text(tokenizer):
    import random

    rng = random.Random(1)
    signs = "aAbéÉß'sS tll<|endoftext|>\n\t 12½ ×÷ÿ.,日本́İΣσς  ǅ"
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(3000):
        extra = ["<|endoftext|>", "'ll", "'S "]
        text = "".join(rng.choice([rng.choice(signs)] * 6 + extra) for _ in range(rng.randint(0, 20)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.of([text])[0], "<u4").tolist() == ids, text


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint_holds(rule):
    lengths = np.random.default_rng(2).integers(1, 900, 3000)
    capacity = (2048, 5, 1_500_000)
    bins, offsets = packing.place(lengths, capacity, (1.0, 0.2, 0.2), rule)
    tokens, documents, cost = (np.bincount(bins, w) for w in (lengths, None, lengths * lengths))
    assert tokens.max() <= 2048 and documents.max() <= 5 and cost.max() <= 1_500_000
    for b in range(3):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offsets[mine])]
        assert offsets[mine].tolist() == np.cumsum([0, *lengths[mine]])[:-1].tolist()
    with pytest.raises(ValueError):
        packing.place(np.array([3000]), capacity, (1.0, 0.0, 0.0))


def test_shards_cover_every_piece(spark):
    cut = spark.range(5000).selectExpr("id", "1 + id % 700 AS length", "'x' AS sequence_id", "id AS shard")
    got = packing.best_fit(cut, per_shard=600).toPandas()
    assert sorted(got.id) == list(range(5000)) and got.columns.tolist() == ["id", "length", "shard", "sequence_id", "offset"]
    check(got)


def test_large_ids_beside_null_ones(spark):
    ids = [2**53 + 1, None, 2**53 + 3, -(2**63), None, 2**63 - 1]
    docs = spark.createDataFrame([(i, "some words " * 900) for i in ids], "doc_id long, text string").coalesce(1)
    got = packing.best_fit(packing.pieces(docs)).select("doc_id", "piece").collect()
    per_text = len(got) // len(ids)
    assert per_text >= 1 and Counter(r.doc_id for r in got) == Counter(i for i in ids for _ in range(per_text))
