"""The N best items of every group, by score histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Items of a group in one task, and hash slots of groups in the table that tells which are split.
SPLIT, SLOTS = 20_000, 1 << 16


def slot(group: Column) -> Column:
    """Never null and known to be so, else a filter on it would go down to the scan of one branch, and the branches
    would not share what is below."""
    return F.xxhash64(group).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def score_bucket(score: Column) -> Column:
    """A whole number that never falls as a whole-number score rises: null is below all, then eight steps a doubling.

    Of the magnitude it holds the number of binary digits and the three digits after the leading one.
    """
    digits = F.length(F.bin(F.abs(score)))
    step = F.when(digits <= 4, F.abs(score)).otherwise((digits - 3) * 8 + (F.conv(F.substring(F.bin(F.abs(score)), 1, 4), 2, 10).cast("int") - 8))
    return F.when(score.isNull(), F.lit(-(10**6))).otherwise((F.when(score < 0, -1).otherwise(1) * step).cast("int"))


def top_n(items: DataFrame, group: str, item: str, score: str, n: int, split: int = SPLIT) -> DataFrame:
    """group, item, score and rank (from 1) of the n best items of each group.

    Higher scores come first, null scores last, equal scores by item ascending. An item that a group has more than
    once counts once, with its highest score. Null groups and null items are left out. Other columns are ignored, so
    their names do not matter. Scores are whole numbers.

    A histogram of scores is made for each group; partial sums leave each task, not rows. The threshold of a group is
    the highest bucket that still has n items in it and above it, so what is kept surely holds the n best. Groups of
    n items or fewer need no threshold.

    Rows meet their threshold by group and salt. A group of more than `split` items has a salt for each `split` of
    them, so none of its tasks gets many more; its threshold is repeated as often. Which groups have salts is told by
    the number of salts in each of SLOTS hash slots of groups, a table of SLOTS rows at the most, which is broadcast;
    a small group that shares its slot with a hot one is split for nothing, that is all. Only rows that pass the
    threshold go on to the exchange by group, and as ranks over n are dropped before that exchange too, a bucket full
    of ties sends n rows from each task.
    """
    rows = (
        items.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), F.col(f"`{score}`").cast("bigint").alias("s"))
        .filter("g IS NOT NULL AND i IS NOT NULL")
        .groupBy("g", "i")
        .agg(F.max("s").alias("s"))
        .withColumn("b", score_bucket(F.col("s")))
    )
    histogram = rows.groupBy("g", "b").agg(F.count("*").alias("c"))
    above = Window.partitionBy("g").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    threshold = (
        histogram.withColumn("above", F.sum("c").over(above))
        .groupBy("g")
        .agg(F.max(F.when(F.col("above") >= n, F.col("b"))).alias("least"), F.max("above").alias("all"))
        .filter(F.col("all") > n)
        .withColumn("slot", slot(F.col("g")))
    )
    hot = threshold.filter(F.col("all") > split).groupBy("slot").agg(F.ceil(F.max("all") / split).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    cuts = threshold.join(F.broadcast(hot), "slot", "left").select(F.col("g").alias("tg"), "least", F.explode(F.sequence(F.lit(0), salts - 1)).alias("ts"))
    salted = rows.withColumn("slot", slot(F.col("g"))).join(F.broadcast(hot), "slot", "left").select("g", "i", "s", "b", F.pmod(F.xxhash64("i"), salts).cast("int").alias("salt"))
    survivors = salted.join(cuts, (F.col("g") == F.col("tg")) & (F.col("salt") == F.col("ts")), "left").filter("least IS NULL OR b >= least").select("g", "i", "s")
    order = Window.partitionBy("g").orderBy(F.col("s").desc_nulls_last(), F.asc("i"))
    return (
        survivors.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("rank").cast("bigint").alias("rank"))
    )
