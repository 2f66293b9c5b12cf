"""Language of web pages by Bayesian fusion of evidence.

Four pieces are multiplied: the likelihood of the visible text (a character-trigram model learned from documents of known
language, tempered since neighbouring trigrams are not independent), how often pages of a language declare what this page's
markup declares, how often they have this address suffix, and a prior of the page's host. Host priors are shrunk towards
their domain's, and those towards the overall one. All counts are sums of text-only posteriors over groups; a page's own
part is left out of its host's and domain's.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

SLOTS = 1 << 16
SAMPLE = 8192  # documents a text model is learned from, dealt equally to the languages
LEAST = 16  # documents of each language, however many languages there are
BUCKETS = 4096  # of the ids' hashes, to find the least of a language without sorting it
FEW_LANGUAGES = 64
TEMPER = 0.1
SHRINK = 5.0  # pages a parent's prior is worth
HIDDEN = ("script", "style", "nav", "template", "noscript")
OPEN = re.compile(rf"<!--|<({'|'.join(HIDDEN)})\b", re.I)
CLOSE = {"!--": re.compile("-->")} | {n: re.compile(rf"</{n}\s*>", re.I) for n in HIDDEN}
TAG = re.compile(r"<[^>]*>")
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
DECLARED = r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z]{2,3})"""
HTML = re.compile("<html", re.I | re.A)
LANG = re.compile(r"""\s(?=lang\s*=\s*["']?([A-Za-z]{2,3}))""", re.I | re.A)


def visible(page: str | None) -> str:
    """What is left of a page without comments, hidden elements and tags; what is never closed stays, and costs one look
    for its end however often it is opened."""
    page, kept, at, seek, endless = page or "", [], 0, 0, set()
    while (m := OPEN.search(page, seek)) is not None:
        kind = next((n for n in HIDDEN if m[1] and re.fullmatch(n, m[1], re.I)), "!--")
        end = None if kind in endless else CLOSE[kind].search(page, m.end())
        if end is None:
            endless.add(kind)
            seek = m.start() + 1
        else:
            kept.append(page[at : m.start()])
            at = seek = end.end()
    text = " ".join([*kept, page[at:]])
    last = text.rfind(">") + 1  # no tag ends after it
    return entities.unescape(TAG.sub(" ", text[:last]) + text[last:])


def declared(page: str | None) -> str | None:
    """The language that the first ``html`` tag with one declares: what DECLARED finds, looking at each sign once."""
    for tag in (page or "").split(">"):
        start = HTML.search(tag)
        found = LANG.findall(tag, start.end()) if start else None
        if found:
            return found[-1].lower()
    return None


def slots(text: str) -> np.ndarray:
    """Hashed trigrams of bytes, A-Z lowered, white space as single spaces."""
    raw = np.frombuffer(b" " + b" ".join(text.encode().lower().split()) + b" ", dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, dtype=np.int64)
    h = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Every language of the table, and for each the log-probability of every slot (half a megabyte).

    Each is learned on its documents of least hash that have words: ``sample`` in all, at least ``LEAST`` for each. Rows
    without an id are taken for a language that has no others."""
    langs = docs.where(F.col(lang).isNotNull()).withColumn("__words", F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    found = langs.groupBy(lang).agg(F.max(F.col("__words") & F.col("doc_id").isNotNull())).collect()
    names = sorted(r[0] for r in found)
    nameless = [r[0] for r in found if not r[1]]
    per = max(LEAST, sample // max(1, len(names)))
    usable = F.col("__words") & (F.col("doc_id").isNotNull() | F.col(lang).isin(nameless)) if nameless else (
        F.col("__words") & F.col("doc_id").isNotNull()
    )
    hashed = F.xxhash64("doc_id")
    ids = langs.where(usable).select(
        F.col(lang).alias("__lang"), F.col("doc_id").alias("__id"), hashed.alias("__hash"),
        F.pmod(hashed, F.lit(BUCKETS)).alias("__bucket"),
    )
    # buckets in their order until they hold enough ids of a language
    before = Window.partitionBy("__lang").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy("__lang", "__bucket").agg(F.count_distinct("__id").alias("__n"))
    reached = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where(F.col("__before") < per)
    near = ids.join(F.broadcast(reached.groupBy("__lang").agg(F.max("__bucket").alias("__last"))), "__lang")
    near = near.where("__bucket <= __last").select("__lang", "__id", "__bucket", "__hash").distinct()
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy("__bucket", "__hash", "__id"))
    chosen = near.withColumn("__rank", rank).where(F.col("__rank") <= per).select("__lang", "__id")
    # at most ``per`` ids of each language
    same = (F.col(lang) == F.col("__lang")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    known = langs.join(F.broadcast(stored(chosen)), same).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for l, t in zip(pdf["lang"], pdf["text"]):
                if l in names and t:
                    np.add.at(sums.setdefault(l, np.zeros(SLOTS, dtype=np.int64)), slots(t), 1)
        for l, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"lang": l, "slot": at, "n": s[at]})

    found = known.mapInPandas(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = np.full((len(names), SLOTS), 0.5)
    got = found.toPandas()
    np.add.at(table, (got["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(dtype=int), got["slot"].to_numpy()), got["n"].to_numpy())
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _sums(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """Sums of the posteriors of a group, combined before they are shuffled: as many expressions as languages, or, where
    these are many, a row for each of a page's posteriors."""
    if n <= FEW_LANGUAGES:
        return rows.groupBy(*by).agg(F.array(*(F.sum(F.col("alone")[i]) for i in range(n))).alias(name))
    each = rows.select(*by, F.posexplode("alone").alias("__at", "__p")).groupBy(*by, "__at").agg(F.sum("__p").alias("__p"))
    whole = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__at", "__p"))).alias(name))
    return whole.withColumn(name, F.transform(name, lambda x: x["__p"]))


def identify(
    pages: DataFrame, languages: list[str], table: np.ndarray, page_id: str = "page_id", url: str = "url",
    page: str = "html", temper: float = TEMPER, shrink: float = SHRINK,
) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, suffix, host for every row of ``pages``.

    Null pages and such without words leave the text's evidence out, null and odd addresses the host's and suffix's,
    and no declaration that of the markup. Repeated rows are pages each. Without languages ``lang`` is null."""
    n = len(languages)
    if not n:
        nothing = {c: F.lit(None).cast("string") for c in ("lang", "text_lang", "declared", "suffix", "host")}
        return pages.select(F.col(page_id).alias("page_id")).withColumns(nothing | {"confidence": F.lit(None).cast("double")})
    shared = pages.sparkSession.sparkContext.broadcast(table)  # 65,536 numbers for each language

    @F.pandas_udf("text array<double>, declared string")
    def read(texts: pd.Series) -> pd.DataFrame:
        t = shared.value
        likelihood = [(t[:, slots(visible(x))].sum(axis=1) * temper).tolist() for x in texts]
        return pd.DataFrame({"text": likelihood, "declared": [declared(x) for x in texts]})

    address = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))
    none = lambda c: F.when(c != "", c)
    seen = pages.select(
        F.col(page_id).alias("page_id"), none(address).alias("host"), read(F.col(page)).alias("read")
    ).select("page_id", "host", "read.declared", "read.text")
    seen = seen.withColumns({
        "domain": F.regexp_extract("host", r"([^.]+\.[^.]+)\.?$", 1), "suffix": F.regexp_extract("host", r"([^.]+)\.?$", 1),
        "alone": _softmax(F.col("text")),
    })
    seen = stored(seen)
    everything = ((_sums(seen, [], n, "sums").first() or [None])[0]) or []
    everything = [x or 0.0 for x in everything] or [0.0] * n
    prior = [(x + 1.0) / (sum(everything) + n) for x in everything]

    hosts = _sums(seen.where("host is not null"), ["domain", "host"], n, "host_sums")
    domains = _sums(seen.where("host is not null"), ["domain"], n, "domain_sums")
    suffixes = _sums(seen.where("host is not null"), ["suffix"], n, "suffix_sums")
    claims = _sums(seen.where("declared is not null"), ["declared"], n, "claim_sums")
    all_ = (
        seen.join(hosts, ["domain", "host"], "left").join(domains, "domain", "left")
        .join(suffixes, "suffix", "left").join(claims, "declared", "left")
    )
    overall, mass = np.array(prior), np.array(everything)

    def matrix(arrays: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a column of arrays, zeros for nulls, and which rows have one."""
        has = arrays.notna().to_numpy()
        out = np.zeros((len(arrays), n))
        if has.any():
            out[has] = np.stack(arrays[has].to_numpy())
        return out, has[:, None]

    # arrays as wide as there are languages: no expression grows with their number
    @F.pandas_udf("lang string, confidence double, text_lang string")
    def decide(
        text: pd.Series, alone: pd.Series, host_sums: pd.Series, domain_sums: pd.Series, suffix_sums: pd.Series,
        claim_sums: pd.Series,
    ) -> pd.DataFrame:
        words, own = matrix(text)[0], matrix(alone)[0]
        before = np.broadcast_to(overall, words.shape)
        for sums in (domain_sums, host_sums):
            got, has = matrix(sums)
            without = np.maximum(got - own, 0.0)
            shrunk = (without + shrink * before) / (without.sum(axis=1, keepdims=True) + shrink)
            before = np.where(has, shrunk, before)
        score = words + np.log(before)
        # P(value | language), smoothed as if one page in the language's mean had the value
        for sums in (suffix_sums, claim_sums):
            got, has = matrix(sums)
            score = score + np.where(has, np.log((got + 1.0) / (mass + n)), 0.0)
        powers = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
        known = np.array(languages, dtype=object)
        best = powers.argmax(axis=1)
        top = powers.max(axis=1) / powers.sum(axis=1)
        return pd.DataFrame({"lang": known[best], "confidence": top, "text_lang": known[words.argmax(axis=1)]})

    sums = ("text", "alone", "host_sums", "domain_sums", "suffix_sums", "claim_sums")
    return all_.withColumn("found", decide(*sums)).select(
        "page_id", "found.lang", "found.confidence", "found.text_lang", "declared", "suffix", "host",
    )
