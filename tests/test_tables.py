import datetime as dt

from conftest import rows

from billow.operators.rank import best_value, keep_first, merged, top_per_group, unseen
from billow.operators.sets import agreement, both, either, missing
from billow.tables import blank, fold, newest
from pyspark.sql import functions as F


def test_fold_and_blank(spark):
    df = spark.createDataFrame([(" A b\t\n",), ("  ",), ("",), (None,), ("\xa0x",)], "v string")
    assert [r[0] for r in df.select(fold("v")).collect()] == ["a b", None, None, None, "\xa0x"]
    assert [r[0] for r in df.select(blank("v")).collect()] == [False, True, True, True, False]


def test_newest_of_three_versions_ties_and_nulls(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, t(1), "x"), (1, t(3), "y"), (1, t(3), "z"), (1, t(2), "w"), (2, None, "n"), (2, t(1), "m"), (None, t(1), "q"), (None, t(2), "r")], "id int, updated_at timestamp, v string")
    assert [(r.id, r.v) for r in newest(df, ["id"]).orderBy("id").collect()] == [(None, "r"), (1, "z"), (2, "m")]
    assert newest(df.limit(0), ["id"]).count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([("f", "a", 5, 0), ("f", "b", 5, 1), ("f", "c", 9, 2), ("g", "a", 1, 3)], "fw string, repo string, stars int, seq int")
    assert rows(top_per_group(df, ["fw"], [F.desc("stars"), F.asc("seq")], 2).select("fw", "repo")) == [("f", "a"), ("f", "c"), ("g", "a")]
    assert rows(keep_first(df, ["repo"], [F.asc("seq")]).select("fw", "repo")) == [("f", "a"), ("f", "b"), ("f", "c")]
    assert rows(best_value(df, ["fw"], F.col("repo"), [-F.col("stars"), F.col("seq")], "best")) == [("f", "c"), ("g", "a")]


def test_merge_and_unseen(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, stars int")
    new = spark.createDataFrame([(1, None, 7), (3, "c", 1)], "id int, name string, stars int")
    assert rows(merged(old, new, "id", ["name", "stars"])) == [(1, "a", 7), (2, "b", 6)]
    assert rows(unseen(new, old, "id").select("id")) == [(3,)]


def test_sets_and_agreement(spark):
    a = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2), ("q", 1)], "g string, i int")
    b = spark.createDataFrame([("p", 2), ("p", 3), ("r", 1)], "g string, i int")
    assert rows(either(a, b)) == [("p", 1), ("p", 2), ("p", 3), ("q", 1), ("r", 1)]
    assert rows(both(a, b)) == [("p", 2)]
    assert rows(missing(a, b)) == [("p", 1), ("q", 1)]
    assert rows(agreement(b, a, ["g"], ["i"])) == [("p", 2, 2, 1, 0.5, 0.5, 0.5), ("q", 1, 0, 0, 0.0, 0.0, 0.0), ("r", 0, 1, 0, 0.0, 0.0, 0.0)]
