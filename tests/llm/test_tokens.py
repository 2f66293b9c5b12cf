import brute
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import queries, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def count(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False))


def test_query(spark, tokenizer):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").toPandas()
    got = queries.op10_token_counts(spark, brute.SF).collect()
    want = [(i, len(t.encode()), count(tokenizer, t)) for i, t in zip(docs.doc_id, docs.text)]
    assert sorted(tuple(r) for r in got) == sorted((*w, w[2] > 1024) for w in want)


def test_chunks_are_spliced_and_widened(spark, tokenizer):
    texts = [
        "ab " * 3000 + "x" * 9000 + "<|endoftext|>" + " y1 'll" * 500, "a" * 5000, "<|endoftext|>" * 900, None, "",
        "日本語" * 4000 + " ok", " " * 4000 + "a" + "\n\n" * 2000, "it's 'we'll " * 900, "1234567890" * 700, "!?" * 3000,
        "end" + "<|endoftext|>tail 12a" * 400, "é é " * 1500,
    ]
    rows = [(i, t, i, "x") for i, t in enumerate(texts + texts[:2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_id long, n_tokens string")
    got = tokens.count_tokens(docs, chunk=500, overlap=26).collect()
    want = [(i, len((t or "").encode()), count(tokenizer, t)) for i, t in enumerate(texts + texts[:2])]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert tokens.count_tokens(docs.where("false")).count() == 0


def test_same_tokens_as_the_library_over_all_of_unicode(tokenizer):
    path = tokens.default_ranks()
    for start in range(0, 0x30000, 64):
        signs = [chr(c) for c in range(start, start + 64) if not 0xD800 <= c <= 0xDFFF]
        text = "".join(f"a{s}1{s}{s} {s}b " for s in signs)
        assert tokens.encode(text, path) == tokenizer.encode(text, add_special_tokens=False).ids, hex(start)
