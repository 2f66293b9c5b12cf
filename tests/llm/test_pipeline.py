from collections import Counter

import brute
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import mixing, queries
from fleetlens.llm.common import documents, stored

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and what each stage made of them."""
    docs = documents(spark, brute.SF)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], brute.SF)))
    return out


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_call_the_operators_in_order():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "source mixing", "best-fit packing"]


def test_classifier_keeps_what_it_predicts(spark, steps):
    kept = {r.doc_id for r in queries.op4_quality_classifier(spark, brute.SF).where("predicted = 1").collect()}
    assert sorted(rows(steps[1])) == sorted(r for r in rows(steps[0]) if r[0] in kept)


def test_near_dedup_keeps_the_least_of_each_component(steps):
    before = rows(steps[1])
    prints = [(r[0], brute.fingerprint(r[1])) for r in before]
    want = [r for r, c in zip(before, brute.components(prints)) if r[0] == c]
    assert sorted(rows(steps[2])) == sorted(want)


def test_repeats_are_cut_out(steps):
    before = rows(steps[2])
    want = []
    for r, (_, removed, _, kept) in zip(before, brute.repeats([r[1] for r in before])):
        text = kept.decode(errors="ignore") if removed else r[1]
        if not removed or brute.WORD.search(text):
            want.append((r[0], text, *r[2:4], len(text) if removed else r[4]))
    assert sorted(rows(steps[3])) == sorted(want)


def test_mixture_has_every_document_by_weight(spark, steps):
    before, after = rows(steps[3]), rows(steps[4])
    expected = mixing.mix_sources(steps[3], mixing.tempered(steps[3])).select("doc_id").collect()
    assert Counter(r[0] for r in after) == Counter(r[0] for r in expected)
    assert set(after) == set(before)


def test_packing_places_every_delivery(spark, steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    after = rows(steps[4])
    want = Counter((r[0], *p) for r, ps in zip(after, brute.packed([r[1] for r in after], tokenizer)) for p in ps)
    got = steps[5].collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(r.offset + r.length <= 2048 for r in got)


def test_run_equals_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, brute.SF)
    assert got.columns == steps[5].columns
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, got.collect())) == Counter(map(key, steps[5].collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_documents_go_through(spark, tmp_path, empty):
    docs = spark.createDataFrame([(*r, 1, "x") for r in brute.odd_rows()], brute.COLUMNS + ", row int, kept string")
    docs = docs.where("false") if empty else docs
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = docs = documents(spark, tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, out, str(tmp_path)))
        assert out.columns == COLUMNS or name == "best-fit packing"
        assert (out.count() == 0) == empty, name
