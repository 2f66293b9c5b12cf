from collections import Counter, defaultdict

import brute
import pytest

from fleetlens.llm import mixing, queries


def test_every_prefix_is_less_than_a_block_from_its_weight():
    import random

    rng = random.Random(2)
    for size in (1, 2, 7, 60, 256):
        slots = mixing.shares({str(i): rng.random() ** 3 + 1e-9 for i in range(size)})
        order = mixing.schedule(slots)
        assert sum(slots.values()) == len(order) == mixing.PERIOD and Counter(order) == slots
        seen = Counter()
        for n, k in enumerate(order * 2, 1):
            seen[k] += 1
            assert all(abs(seen[s] - n * w / mixing.PERIOD) < 1 for s, w in slots.items())


def simulated(slots, blocks):
    """Deliveries (class, epoch, block) by slot, one slot after the other, until all classes are whole."""
    out, given, order = {}, Counter(), mixing.schedule(slots)
    while any(given[k] < n for k, n in blocks.items()):
        k = order[len(out) % len(order)]
        out[len(out)] = (k, given[k] // blocks[k], given[k] % blocks[k])
        given[k] += 1
    return out


def check(got, weights, block, n_rows):
    """got: (class, row, size, block, epoch, slot) of each delivery."""
    rows = {r[1]: r for r in got}
    assert len(rows) == n_rows
    sizes = Counter()
    for k, _, size, *_ in rows.values():
        sizes[k] += size
    blocks = {k: -(-n // block) for k, n in sizes.items()}
    plan = simulated(mixing.shares({k: weights[k] for k in blocks}), blocks)
    where = defaultdict(set)
    for slot, (k, epoch, b) in plan.items():
        where[k, b].add((epoch, slot))
    found = defaultdict(set)
    for k, row, _, b, epoch, slot in got:
        assert (epoch, slot) not in found[row]
        found[row].add((epoch, slot))
    for row, (k, _, _, b, _, _) in rows.items():
        assert found[row] == where[k, b]
    # a class's rows fill its blocks in a row: those that begin in a block begin within its bounds
    for k in blocks:
        starts = Counter()
        for r in rows.values():
            if r[0] == k:
                starts[r[3]] += r[2]
        total = 0
        for b in sorted(starts):
            assert total // block <= b
            total += starts[b]
        assert max(starts) < blocks[k]


def test_query(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    sizes = {r.doc_id: len(r.text) + 1 for r in docs.select("doc_id", "text").collect()}
    got = queries.op6_source_mixing(spark, brute.SF).collect()
    rows = [("=" + r.source, r.doc_id, sizes[r.doc_id], r.block, r.epoch, r.slot) for r in got]
    check(rows, mixing.tempered(docs), mixing.BLOCK, len(sizes))


@pytest.mark.parametrize("per_part", [50_000, 40])
def test_hot_source_parts_and_the_rest(spark, per_part):
    rows = [(i, "w" * (i * 37 % 90), "hot" if i % 3 else f"s{i % 7}") for i in range(900)] + [(900, None, None), (901, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS slot")
    weights = {"=hot": 3.0, "=s1": 1.0, "=s2": 2.0, "=absent": 5.0, "null": 0.5, "rest": 1.5}
    got = mixing.mix_sources(docs, weights, block=300, rows_per_part=per_part).collect()
    size = {i: len(t or "") + 1 for i, t, _ in rows}
    name = {i: k if (k := "null" if s is None else "=" + s) in weights else "rest" for i, _, s in rows}
    out = [(name[r.doc_id], r.doc_id, size[r.doc_id], r.block, r.epoch, r.slot) for r in got]
    check(out, weights, 300, len(rows))
    assert max(r.epoch for r in got) > 0


def test_odd_rows(spark):
    docs = spark.createDataFrame(brute.odd_rows(), brute.COLUMNS)
    got = mixing.mix_sources(docs, mixing.tempered(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in got if not r.epoch) == Counter(r[:2] for r in brute.odd_rows())
    assert mixing.mix_sources(docs, {}).count() >= len(brute.odd_rows())
    empty = docs.where("false")
    assert mixing.mix_sources(empty, mixing.tempered(empty)).count() == 0
    with pytest.raises(ValueError):
        mixing.shares({str(i): 1.0 for i in range(mixing.PERIOD + 1)})


@pytest.mark.parametrize("size", [10, 100, 256])
def test_every_prefix_is_less_than_a_block_from_the_target(size):
    """Against the weights themselves: a third for one source, the rest by tempered sizes, one of a single block."""
    sizes = {"big": 2000} | {f"s{i:03}": 1 + 37 * i % 50 for i in range(size - 1)}
    rest = sum(n**0.9 for k, n in sizes.items() if k != "big")
    weights = {k: rest / 2 if k == "big" else n**0.9 for k, n in sizes.items()}
    slots = mixing.shares(weights, mixing.period_for(weights, sizes))
    order = mixing.schedule(slots, sizes)
    share = {k: w / sum(weights.values()) for k, w in weights.items()}
    seen = Counter()
    for n, k in enumerate(order, 1):
        seen[k] += 1
        if n % 7 == 0 or n == len(order):
            assert all(abs(seen[s] - n * w) < 1 + 1e-3 for s, w in share.items())
    assert all(seen[k] >= n for k, n in sizes.items()) and len(order) > mixing.PERIOD


def test_delivered_blocks_follow_the_target_weights(spark):
    rows = [(i, "w" * 99, "hot" if i % 3 == 0 else f"s{i % 97:02}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = mixing.tempered(docs)
    total = sum(weights.values())
    sent = mixing.mix_sources(docs, weights, block=100).select("source", "slot").collect()
    end = 1 + max(r.slot for r in sent)
    count = Counter("=" + r.source for r in sent)
    assert len({r.slot for r in sent}) == len(sent) == end
    assert all(abs(count[k] - end * w / total) < 1.001 for k, w in weights.items())


@pytest.mark.parametrize("per_part", [50_000, 100])
def test_every_source_beyond_the_largest_has_its_own_weight(spark, per_part):
    """Three sources of 100 blocks and 1,500 of a hundredth of a block, each by its own tempered size."""
    rows = [(i, "w" * 99, f"big{i % 3}") for i in range(300)] + [(1000 + i, "w" * (i % 3), f"s{i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = mixing.tempered(docs)
    total = sum(weights.values())
    assert len(weights) == 1503 and weights["=s2"] == pytest.approx(3**0.9)
    sent = mixing.mix_sources(docs, block=100, rows_per_part=per_part).collect()
    small = [r for r in sent if r.source[0] == "s"]
    assert Counter(r.source for r in small) == {f"s{i}": 1 for i in range(1500)}
    by_slot = defaultdict(set)
    for r in sent:
        by_slot[r.slot].add(r.source if r.source[0] == "b" else "small")
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(k) == 1 for k in by_slot.values())
    share = {f"big{i}": weights[f"=big{i}"] / total for i in range(3)}
    share["small"] = 1 - sum(share.values())
    seen = Counter()
    for n in range(len(by_slot)):
        seen.update(by_slot[n])
        assert all(abs(seen[k] - (n + 1) * w) < 1.01 for k, w in share.items())
    filled = Counter()
    for r in small:
        filled[r.slot] += len(r.text) + 1
    assert max(filled.values()) <= 100 and len(filled) > 60


def test_weights_for_any_number_of_sources(spark):
    rows = [(i, "w" * 9, f"s{i:04}") for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sent = mixing.mix_sources(docs, {f"={s}": 1.0 for _, _, s in rows}, block=10).collect()
    assert sorted(r.slot for r in sent) == list(range(1100)) and len({r.doc_id for r in sent}) == 1100
    tiny = mixing.mix_sources(docs, {f"={s}": 1.0 if i else 1e-9 for i, _, s in rows}, block=11).collect()
    assert Counter(r.doc_id for r in tiny)[0] == 1
