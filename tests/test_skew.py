import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from billow.operators.skew import eager_join, heavy


def test_counts_equal_the_joined_rows(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (3, None)], "k int, g string")
    right = spark.createDataFrame([(1,), (1,), (2,), (4,), (None,)], "k int")
    out = eager_join(left, right, F.col("k"), F.col("k"), F.col("g"))
    assert rows(out.groups) == sorted([("a", 4, 5), ("b", 1, 2), (None, 1, 0)], key=repr)
    assert rows(out.keys) == sorted([(1, 3, 2, 6), (2, 1, 1, 1), (3, 1, 0, 0), (4, 0, 1, 0), (None, 1, 1, 0)], key=repr)


def test_empty_inputs(spark):
    left = spark.createDataFrame([], "k int, g string")
    out = eager_join(left, left, F.col("k"), F.col("k"), F.col("g"))
    assert rows(out.groups) == [] and rows(out.keys) == []
    assert rows(heavy(out)) == []


def test_heavy_counts_nameless_rows_in_the_total(spark):
    left = spark.createDataFrame([(k, g) for g, n in (("a", 3), ("b", 2), (None, 95)) for k in range(n)], "k int, g string")
    right = spark.createDataFrame([(7,)] * 60 + [(200,)] * 4 + [(None,)] * 36, "k int")
    out = eager_join(left, right, F.col("k"), F.col("k"), F.col("g"))
    assert rows(heavy(out)) == sorted([(None, "a", 2, 3), (7, None, 1, 60), (200, None, 1, 4)], key=repr)
    assert rows(heavy(out, (2, 100)))[-1] is not None and len(rows(heavy(out, (2, 100)))) == 4


@pytest.mark.parametrize("seed", range(3))
def test_random_rows_with_hot_and_null_keys(spark, seed):
    rnd = random.Random(seed)
    left = [(rnd.choice([1, 1, 1, 1, None, *range(12)]), rnd.choice(["hot", "hot", "hot", None, *"abc"])) for _ in range(300)]
    right = [(rnd.choice([1, 1, 1, None, *range(6, 20)]),) for _ in range(200)]
    out = eager_join(spark.createDataFrame(left, "k int, g string"), spark.createDataFrame(right, "k int"), F.col("k"), F.col("k"), F.col("g"))
    of_right, of_left = Counter(k for k, in right), Counter(k for k, _ in left)
    n, pairs = Counter(g for _, g in left), Counter()
    for k, g in left:
        pairs[g] += of_right[k] if k is not None else 0
    assert rows(out.groups) == sorted(((g, n[g], pairs[g]) for g in n), key=repr)
    assert rows(out.keys) == sorted(((k, of_left[k], of_right[k], of_left[k] * of_right[k] if k is not None else 0) for k in {*of_left, *of_right}), key=repr)
    want = {("group", g) for g in n if g is not None and n[g] * 100 >= 3 * len(left)} | {("key", k) for k in of_right if k is not None and of_right[k] * 100 >= 3 * len(right)}
    assert {("group", r.group) if r.left_out == 2 else ("key", r.key) for r in heavy(out).collect()} == want
