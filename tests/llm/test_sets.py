"""Operators on counts and sets, against brute force on random tables with skew, nulls and repeated rows."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from billow.llm import pairs, setjoin
from billow.llm.terms import counted_pairs, field_sizes, marks, scan_runs, term_frequencies
from billow.llm.topn import score_bucket, top_n


def test_buckets_never_fall(spark):
    values = [None, *range(-70, 70), *[2**k + d for k in range(7, 62) for d in (-1, 0, 1)], -(2**40)]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v bigint").orderBy(F.col("v").asc_nulls_first()).select(score_bucket(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("seed", range(3))
def test_top_n(spark, seed):
    rnd = random.Random(seed)
    items = [(rnd.choice(["hot", "hot", "a", "b", None, ""]), rnd.choice([None, *range(60)]), rnd.choice([None, 0, 1, 7, 7, 1000, 5000])) for _ in range(400)]
    df = spark.createDataFrame([(*x, "n") for x in items], "g string, i bigint, s bigint, rank string")
    best = {}
    for g, i, s in items:
        if g is not None and i is not None:
            best[g, i] = max(best.get((g, i), -1), -1 if s is None else s)
    want = []
    for g in {g for g, _ in best}:
        order = sorted(((-s, i) for (h, i), s in best.items() if h == g))
        want += [(g, i, None if s == 1 else -s, k) for k, (s, i) in enumerate(order[:5], 1)]
    assert rows(top_n(df, "g", "i", "s", 5)) == sorted(want, key=repr)
    assert rows(top_n(df, "g", "i", "s", 5, split=7)) == sorted(want, key=repr)
    assert top_n(df.limit(0), "g", "i", "s", 5).count() == 0


def test_hot_groups_are_split_and_cut_before_they_meet(spark):
    """Rows go by group and salt, and the ranks are limited in every task before the exchange by group."""
    rnd = random.Random(6)
    items = [("hot" if k % 4 else f"g{k % 50}", k, rnd.randrange(10**6)) for k in range(40_000)]
    df = spark.createDataFrame(items, "g string, i bigint, s bigint")
    out = top_n(df, "g", "i", "s", 5, split=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 5, Partial" in plan and "hashpartitioning(g" in plan and "salt" in plan
    best = sorted(((-s, i) for g, i, s in items if g == "hot"))[:5]
    assert [(r.i, r.s) for r in out.filter("g = 'hot'").orderBy("rank").collect()] == [(i, -s) for s, i in best]


def test_terms(spark):
    rnd = random.Random(5)
    data = [(rnd.choice(["x", "y"]), rnd.choice(["hot"] * 6 + ["a", "b", "é", None]), rnd.choice([1, 1, 1, *range(30), None])) for _ in range(3000)]
    data += [("x", "only", 7)]
    df = spark.createDataFrame([(*x, 1) for x in data], "field string, term string, record bigint, part int")
    count, records = Counter(), defaultdict(set)
    for f, t, r in data:
        if t is not None and r is not None:
            count[f, t] += 1
            records[f, t].add(r)
    want = sorted(((f, t, n, len(records[f, t])) for (f, t), n in count.items()), key=repr)
    assert rows(term_frequencies(counted_pairs(df, "field", "term", "record"))) == want
    assert term_frequencies(counted_pairs(df.limit(0), "field", "term", "record")).count() == 0
    have = {f: {r for x, t, r in data if x == f and None not in (t, r)} for f in "xy"}
    assert rows(field_sizes(counted_pairs(df, "field", "term", "record"))) == [("x", len(have["x"])), ("y", len(have["y"]))]
    sizes = spark.createDataFrame([("x", 30), ("y", 30)], "field string, total bigint")
    marked = {(r.field, r.term): r.mark for r in marks(term_frequencies(counted_pairs(df, "field", "term", "record")), sizes).collect()}
    assert marked["x", "hot"] == "common" and marked["x", "only"] == "rare"


def test_runs_go_over_batches():
    make = lambda r: pa.record_batch([pa.array([x[0] for x in r], pa.string()), pa.array([x[1] for x in r], pa.string()), pa.array([x[2] for x in r], pa.int64())], ["field", "term", "n"])
    data = sorted(("f", t, n) for t in ("a", "b", "b", "c") for n in (1, 2, 3))
    for cut in range(1, len(data)):
        for cut2 in range(cut, len(data)):
            out = [r for b in scan_runs(iter([make(data[:cut]), make(data[cut:cut2]), make(data[cut2:])])) for r in zip(*[c.to_pylist() for c in b.columns])]
            assert out == [("f", "a", 6, 3), ("f", "b", 12, 6), ("f", "c", 6, 3)]


def similar(sets, least=1, share=(4, 5)):
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a]) >= least and len(sets[b]) >= least and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b]))


@pytest.mark.parametrize("seed", range(4))
def test_similar_pairs(spark, seed):
    rnd = random.Random(seed)
    sets = {}
    for i in range(160):
        kind = rnd.random()
        if kind < 0.3:
            sets[i] = set(range(12))  # a third are copies
        elif kind < 0.7 and sets:
            base = set(rnd.choice(list(sets.values())))
            for _ in range(rnd.randint(0, 3)):
                base ^= {rnd.randrange(60)}
            sets[i] = base
        else:
            sets[i] = {rnd.randrange(60) for _ in range(rnd.randint(1, 40))}
    data = [(i, str(t), 1) for i, s in sets.items() for t in s]
    data += rnd.sample(data, 20) + [(None, "1", 1), (3, None, 1)]
    df = spark.createDataFrame(data, "record bigint, token string, rep int")
    found = setjoin.similar_pairs(setjoin.token_sets(df, "record", "token"), (4, 5), 3)
    got = [(r.record_a, r.record_b) for r in found.collect()]
    assert len(got) == len(set(got)) and sorted(got) == similar(sets, least=3)


@pytest.mark.parametrize("length", [1, 2, 3])
def test_every_prefix_length_finds_all(spark, monkeypatch, length):
    rnd = random.Random(9)
    sets = {i: {rnd.randrange(25) for _ in range(rnd.randint(3, 22))} for i in range(120)}
    monkeypatch.setattr(setjoin, "prefix_lengths", lambda sets, share: dict.fromkeys(range(60), length))
    least = length + 1  # two smaller sets need not share that many tokens
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "record bigint, token int")
    found = setjoin.similar_pairs(setjoin.token_sets(df, "record", "token"), least=least)
    assert sorted((r.record_a, r.record_b) for r in found.collect()) == similar(sets, least=least)


@pytest.mark.parametrize(("vocabulary", "size", "length"), [(120, 9, 2), (30, 9, 3)])
def test_common_tokens_make_longer_prefixes_win(spark, monkeypatch, vocabulary, size, length):
    rnd = random.Random(11)
    sets = {}
    for i in range(700):
        sets[i] = set(rnd.sample(range(vocabulary), size)) if i % 4 else set(sets[i - 3]) ^ {rnd.randrange(vocabulary)} if i else {1}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "record bigint, token int")
    chosen, real = {}, setjoin.prefix_lengths
    monkeypatch.setattr(setjoin, "prefix_lengths", lambda *x: chosen.update(real(*x)) or chosen)
    found = setjoin.similar_pairs(setjoin.token_sets(df, "record", "token"), (4, 5), 5)
    assert sorted((r.record_a, r.record_b) for r in found.collect()) == similar(sets, least=5)
    assert length in chosen.values()


@pytest.mark.parametrize(("share", "vocabulary"), [((1, 2), 30), ((9, 10), 60)])
def test_other_shares(spark, share, vocabulary):
    rnd = random.Random(vocabulary)
    sets = {}
    for i in range(250):
        sets[i] = set(rnd.choice(list(sets.values()))) if i % 3 and sets else set(rnd.sample(range(vocabulary), rnd.randint(1, 28)))
        for _ in range(rnd.randint(0, 3)):
            sets[i] = sets[i] ^ {rnd.randrange(vocabulary)} or {0}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "record bigint, token int")
    found = setjoin.similar_pairs(setjoin.token_sets(df, "record", "token"), share)
    assert sorted((r.record_a, r.record_b) for r in found.collect()) == similar(sets, share=share)


def test_no_record_writes_more_combinations_than_the_bound(spark):
    sets = spark.createDataFrame([(n, list(range(n))) for n in (1, 2, 5, 8, 30, 60, 150, 500, 5000)], "rep bigint, tokens array<bigint>")
    longest = [max(setjoin.allowed_lengths(group, (4, 5))) for group in range(40)]
    assert longest[0] == 1 and 3 in longest and longest[-1] == 1
    pick = F.element_at(F.array(*map(F.lit, longest)), F.col("class") + 1)
    counts = setjoin.signatures(sets, (4, 5), pick, upper=True).groupBy("rep", "class").count().collect()
    assert max(r["count"] for r in counts if longest[r["class"]] > 1) <= setjoin.MOST
    assert max(r["count"] for r in counts) <= 1001


def test_classes_and_links(spark):
    sets = {1: "abcdefghij", 2: "abcdefghij", 3: "abcdefghi", 4: "abcdefghik", 5: "vwxyz", 9: "vwxyz", 6: "q"}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "record bigint, token string")
    found = setjoin.similar_classes(setjoin.token_sets(df, "record", "token"))
    assert rows(found.links) == [(1, 3, 9, 10), (1, 4, 9, 11), (3, 4, 9, 10)]
    assert rows(setjoin.record_links(found)) == [(1, 1, 3), (2, 1, 3), (3, 3, 3), (4, 4, 3), (5, 5, 1), (6, 6, 0), (9, 5, 1)]
    assert [tuple(r)[:2] for r in rows(setjoin.expanded(found))] == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 9)]


def test_no_sets(spark):
    df = spark.createDataFrame([], "record bigint, token string")
    assert setjoin.similar_pairs(setjoin.token_sets(df, "record", "token")).count() == 0


@pytest.mark.parametrize(("dense", "part"), [((5, 100), 256), ((1, 2), 256), ((1, 1), 3), ((101, 100), 2), ((101, 100), 5)])
def test_item_pairs(spark, dense, part):
    rnd = random.Random(3)
    data = [(rnd.choice(["s", "s", "t", None]), f"b{min(int(rnd.expovariate(0.05)), 60)}", rnd.choice(["hot", "hot", *"abcdefghijk", None])) for _ in range(1500)]
    df = spark.createDataFrame([(*x, 0) for x in data], "space string, basket string, item string, n int")
    clean = {x for x in data if None not in x}
    baskets, single, both = defaultdict(set), Counter(), Counter()
    for s, b, i in clean:
        baskets[s, b].add(i)
        single[s, i] += 1
    for (s, _), items in baskets.items():
        both.update((s, *p) for p in itertools.combinations(sorted(items), 2))
    total = Counter(s for s, _ in baskets)
    want = sorted((s, a, b, n) for (s, a, b), n in both.items() if n >= 5 and n * 100 >= 2 * total[s] and n * total[s] >= 1.05 * single[s, a] * single[s, b])
    out = pairs.item_pairs(df, "space", "basket", "item", lift=1.05, dense_share=dense, part=part).collect()
    assert sorted((r.space, r.item_a, r.item_b, r.both) for r in out) == want and want
    assert all(r.baskets_a == single[r.space, r.item_a] and r.baskets == total[r.space] for r in out)
    assert pairs.item_pairs(df.limit(0), "space", "basket", "item").count() == 0


def batches_of(data, size):
    columns = list(zip(*data, strict=True))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_())
    whole = pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["space", "basket", "item", "dense"])
    return (whole.slice(k, size) for k in range(0, whole.num_rows, size))


@pytest.mark.parametrize(("size", "block", "most"), [(7, 3, 10**6), (1000, 2, 10**6), (3, 1000, 11), (1000, 1000, 10**6), (5, 1, 1)])
def test_blocks_begin_and_end_anywhere(monkeypatch, size, block, most):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", most)
    rnd = random.Random(1)
    data = sorted({(rnd.choice("st"), f"b{rnd.randrange(12)}", i := rnd.randrange(9), i < 4) for _ in range(150)})
    held, want, got = defaultdict(set), Counter(), Counter()
    for space, basket, item, _ in data:
        held[space, basket].add(item)
    for (space, _), items in held.items():
        want.update((space, a, b) for a, b in itertools.combinations(sorted(items), 2) if a < 4)
    for batch in pairs.count_blocks(batches_of(data, size)):
        for space, a, b, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            got[space, a, b] += n
    assert got == want


def test_wide_baskets_need_little_memory():
    import tracemalloc

    def wide():
        for basket in range(40):
            items = np.arange(30_000, dtype=np.int32)
            for k in range(0, 30_000, 10_000):
                part = items[k : k + 10_000]
                yield pa.record_batch([pa.array(["s"] * 10_000), pa.array([f"b{basket:03}"] * 10_000), pa.array(part), pa.array(part < 20)], ["space", "basket", "item", "dense"])

    tracemalloc.start()
    found = sum(int(np.sum(batch.column(3).to_numpy())) for batch in pairs.count_blocks(wide()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 40 * (20 * 19 // 2 + 20 * 29_980)
    assert peak < 150e6
