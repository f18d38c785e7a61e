"""Packings are valid and use few containers."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wordloom.llm.packing import packed_items, packed_lengths


@pytest.mark.parametrize("capacity", [1, 2, 7, 30, 256])
def test_plan_holds_every_item(capacity):
    r = random.Random(capacity)
    for _ in range(60):
        lengths = {s: r.randint(0, 6) for s in range(1, capacity + 1) if r.random() < 0.5}
        held = Counter()
        for g in packed_lengths(dict(lengths), capacity):
            load = sum(s * k for s, k in g.fill)
            assert g.count > 0 and load + g.gap == capacity and g.gap >= 0
            assert sum(k for s, k in g.fill if 3 * s > capacity) <= 2
            for s, k in g.fill:
                held[s] += k * g.count
        assert held == Counter({s: n for s, n in lengths.items() if n})


def test_plan_is_close_to_the_bound():
    r = random.Random(0)
    lengths = Counter(min(1000, 1 + int(r.expovariate(1 / 200))) for _ in range(20_000))
    groups = packed_lengths(dict(lengths), 1000)
    total = sum(s * n for s, n in lengths.items())
    assert sum(g.count for g in groups) <= 1.005 * -(-total // 1000) + 1


def test_pairs_of_large_items():
    assert sum(g.count for g in packed_lengths({60: 3, 40: 3}, 100)) == 3
    assert sum(g.count for g in packed_lengths({51: 4}, 100)) == 4
    assert sum(g.count for g in packed_lengths({50: 5}, 100)) == 3


def test_huge_counts_stay_a_small_plan():
    groups = packed_lengths({s: 10**9 + s for s in range(1, 1025)}, 1024)
    assert len(groups) < 5000


def check(rows, lengths, capacity):
    held, load, pieces = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in rows:
        held[r.doc_id] += r.n_tokens
        load[r.container] += r.n_tokens
        pieces[r.doc_id].append(r.piece)
    assert dict(held) == lengths and max(load.values()) <= capacity
    assert set(load) == set(range(len(load)))
    for d, p in pieces.items():
        assert sorted(p) == list(range(-(-lengths[d] // capacity)))
    return len(load)


def test_items(spark):
    r = random.Random(5)
    # A third of the items have one length, some are far beyond the capacity.
    lengths = {i: 3 if i % 3 == 0 else r.choice([1, 99, 100, 101, 250, 1000]) if i % 50 == 1 else r.randint(1, 60) for i in range(3000)}
    items = spark.createDataFrame(list(lengths.items()), "doc_id bigint, n_tokens bigint").withColumn("capacity", F.lit("clash")).withColumn("rank", F.lit(1))
    more = spark.createDataFrame([(90_001, None), (90_002, 0), (90_003, -4)], "doc_id bigint, n_tokens bigint").withColumn("capacity", F.lit("x")).withColumn("rank", F.lit(1))
    specs = spark.createDataFrame([(1, 100, "a"), (2, 37, "b"), (2, 40, "c"), (None, 5, "d"), (4, None, "e")], "spec_id bigint, capacity bigint, doc_id string")
    rows = packed_items(items.unionByName(more), specs).collect()
    assert {x.spec_id for x in rows} == {1, 2}
    total = sum(lengths.values())
    for spec, capacity in ((1, 100), (2, 37)):
        n = check([x for x in rows if x.spec_id == spec], lengths, capacity)
        assert n <= 1.02 * total / capacity + 1


def test_nothing(spark):
    items = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([(1, 100)], "spec_id bigint, capacity bigint")
    assert packed_items(items, specs).count() == 0
    full = spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens bigint")
    assert packed_items(full, specs.where("capacity < 0")).count() == 0
    with pytest.raises(ValueError):
        packed_items(full, spark.createDataFrame([(1, 10**9)], "spec_id bigint, capacity bigint"))


def test_repeated_ids(spark):
    items = spark.createDataFrame([(1, 30), (1, 30), (None, 30)], "doc_id bigint, n_tokens bigint")
    rows = packed_items(items, spark.createDataFrame([(1, 60)], "spec_id bigint, capacity bigint")).collect()
    assert sorted(r.container for r in rows) == [0, 0, 1]
