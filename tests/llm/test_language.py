import math
from collections import defaultdict

import brute
import numpy as np
import pytest

from fleetlens.llm import language, queries


def brute_force(pages, names, table, temper=language.TEMPER, shrink=language.SHRINK):
    """pages: (id, url, html). Posterior of each page by the formula, one page at a time."""
    import re

    n, out, seen = len(names), [], []
    for i, url, page in pages:
        text = table[:, language.slots(language.visible(page))].sum(axis=1) * temper
        alone = np.exp(text - text.max())
        m = re.search(language.HOST, url or "")
        host = m[1].lower() if m else None
        labels = host.rstrip(".").split(".") if host else []
        d = re.search(language.DECLARED, page or "")
        domain = ".".join(labels[-2:]) if len(labels) > 1 else "" if host else None
        seen.append((i, text, alone / alone.sum(), host, domain, labels[-1] if labels else None, d[1].lower() if d else None))
    total = sum((s[2] for s in seen), np.zeros(n))
    overall = (total + 1) / (total.sum() + n)
    sums = [defaultdict(lambda: np.zeros(n)) for _ in range(4)]
    for s in seen:
        for k, group in enumerate(s[3:]):
            sums[k][group] = sums[k][group] + s[2]
    for i, text, alone, host, domain, suffix, declared in seen:
        prior, score = overall, text.copy()
        if host is not None:
            for k, group in ((1, domain), (0, host)):
                own = np.maximum(sums[k][group] - alone, 0)
                prior = (own + shrink * prior) / (own.sum() + shrink)
            score += np.log((sums[2][suffix] + 1) / (total + n))
        if declared is not None:
            score += np.log((sums[3][declared] + 1) / (total + n))
        score += np.log(prior)
        p = np.exp(score - score.max())
        out.append((i, names[int(np.argmax(p))], float(p.max() / p.sum()), declared, suffix, host))
    return out


def test_query(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    pages = [tuple(r) for r in spark.read.parquet(f"{brute.SF}/pages.parquet").select("page_id", "url", "html").collect()]
    names, table = language.learn(docs)
    want = {w[0]: w[1:] for w in brute_force(pages, names, table)}
    got = queries.op7_language_id(spark, brute.SF).collect()
    assert len(got) == len(pages)
    for r in got:
        lang, confidence, declared, suffix, host = want[r.page_id]
        assert (r.lang, r.declared, r.suffix, r.host) == (lang, declared, suffix, host)
        assert r.confidence == pytest.approx(confidence)
    assert np.mean([r.lang == r.declared for r in got]) > 0.95  # these pages declare their language truly


def test_text_model_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    names, table = language.learn(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").select("text", "lang").collect()
    right = [names[int(np.argmax(table[:, language.slots(r.text)].sum(axis=1)))] == r.lang for r in held]
    assert np.mean(right) > 0.9


def test_evidence_beside_the_text_decides_where_it_says_nothing(spark):
    docs = spark.createDataFrame(
        [(1, "the house and the garden and the tree", "en"), (2, "das haus und der garten und der baum", "de"), (3, None, "en"), (4, "x", None)],
        "doc_id long, text string, lang string",
    )
    names, table = language.learn(docs)
    german = "<html lang='de'><p>das haus und der garten</p></html>"
    english = "<html lang=en><script>der der der</script><p>the house and the garden</p></html>"
    pages = [(i, f"http://www.host{i % 3}.de/x", german) for i in range(30)]
    pages += [(100 + i, f"https://user@en{i % 3}.example.com:80/x?y", english) for i in range(30)]
    pages += [
        (200, "http://www.host1.de/empty", ""), (201, "http://en1.example.com", None), (202, None, "<html lang='de'>"),
        (203, "not an address", "<p>the garden</p>"), (204, "http://localhost/", german), (None, None, None), (200, "http://www.host1.de/empty", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'q' AS lang", "1 AS host")
    want = sorted(brute_force(pages, names, table), key=str)
    got = sorted(((r.page_id, r.lang, r.confidence, r.declared, r.suffix, r.host) for r in language.identify(df, names, table).collect()), key=str)
    assert [(g[0], g[1], g[3:]) for g in got] == [(w[0], w[1], w[3:]) for w in want]
    assert all(math.isclose(g[2], w[2]) for g, w in zip(got, want))
    lang = {g[0]: g[1] for g in got}
    assert (lang[200], lang[201], lang[202]) == ("de", "en", "de")


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    names, table = language.learn(docs)
    assert names == []
    one = spark.createDataFrame([(1, "http://a.b", "x")], pages.schema)
    assert language.identify(one, names, table).first().lang is None
    assert language.identify(pages, ["en"], np.zeros((1, language.SLOTS))).count() == 0


def test_every_language_has_a_row_learned_from_its_documents(spark):
    """Forty languages, one of them in two of every three documents and the last in one document only."""
    rows = [(i, f"hot words go on {i}", "l00") for i in range(2000)]
    rows += [(5000 + 30 * k + i, f"{chr(97 + k % 26) * 3}{k}q{k}z " * 20, f"l{k:02}") for k in range(1, 39) for i in range(25)]
    rows += [(None, "rare rare tongue", "l39")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, table = language.learn(docs, sample=80)
    assert names == [f"l{k:02}" for k in range(40)] and table.shape == (40, language.SLOTS)
    assert all(np.ptp(row) > 0 for row in table)
    pages = [(k, f"http://h{k}.x/", f"<p>{t}</p>") for k, t in enumerate({l: t for _, t, l in rows}.values())]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identify(df, names, table).collect()}
    want = {w[0]: w for w in brute_force(pages, names, table)}
    assert all(got[k].lang == want[k][1] and got[k].confidence == pytest.approx(want[k][2]) for k in want)
    assert all(got[k].text_lang == names[k] for k in want)


def test_reading_of_markup_equals_the_patterns():
    import random
    import re

    hidden = re.compile(r"<!--.*?-->|<(script|style|nav|template|noscript)\b.*?</\1\s*>", re.S | re.I)
    rng = random.Random(3)
    parts = ["<!--", "-->", "<script", "<SCRIPT src=x>", "</script >", "</Script", "<style>", "</style>", "<nav ", "</nav>", "<", ">", "a", " ",
             "<html", "<HTML x", " lang=en", "\tLANG = 'deu", " lang=", "\n", "x lang=f", "&amp;", "<!-", "-", "<navy>"]
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        plain = language.entities.unescape(re.sub("<[^>]*>", " ", hidden.sub(" ", page)))
        assert language.visible(page) == plain, page
        m = re.search(language.DECLARED, page, re.A)
        assert language.declared(page) == (m[1].lower() if m else None), page


@pytest.mark.parametrize("part", ["<!--", "<script ", "<", "<html lang", "<html ", "</script ", "<script></script", "<!---->", " lang=", "&"])
def test_hostile_pages_take_linear_time(part):
    import time

    page, start = part * (1_000_000 // len(part)), time.process_time()
    language.visible(page)
    language.declared(page)
    assert time.process_time() - start < 2


def test_long_repeated_and_clashing_rows(spark):
    names, table = ["de", "en"], np.log(np.random.default_rng(1).dirichlet(np.ones(language.SLOTS), 2))
    page = "<html lang=en>" + "the long page goes on and on " * 20_000
    pages = [(1, "http://a.b.com/", page)] * 3 + [(2, "http://a.b.com/", "<!--" * 1000 + "text")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS text", "1 AS alone", "'y' AS declared", "2 AS domain", "3 AS read", "4 AS found", "'z' AS confidence"
    )
    want = sorted(brute_force(pages, names, table))
    got = sorted((r.page_id, r.lang, r.confidence, r.declared, r.suffix, r.host) for r in language.identify(df, names, table).collect())
    assert [(g[0], g[1], g[3:]) for g in got] == [(w[0], w[1], w[3:]) for w in want]


def test_five_hundred_languages(spark):
    rng = np.random.default_rng(7)
    names = [f"l{k:03}" for k in range(500)]
    table = np.log(rng.dirichlet(np.full(64, 0.3), 500)[:, rng.integers(0, 64, language.SLOTS)] + 1e-6)
    pages = [(i, f"http://h{i % 3}.example.com/", f"<html lang=l{i % 2}x><p>words of page {i} {i * i}</p>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {w[0]: w for w in brute_force(pages, names, table)}
    got = {r.page_id: r for r in language.identify(df, names, table).collect()}
    assert all(got[k].lang == want[k][1] and got[k].confidence == pytest.approx(want[k][2]) for k in want)
