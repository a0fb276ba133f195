"""Sets of rows and how two of them agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billow.functions.scalars import ratio


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(a.columns))


def missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks."""
    return a.subtract(b.select(a.columns))


def agreement(found: DataFrame, truth: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """group, n_truth, n_found, n_both, precision, recall, f1: how two sets of items agree in each group of either.

    One pass: rows of both sides are united with a flag and made one row an item, then counted; there is no join, and a
    hot group is aggregated in part before each exchange. Repeated items count once. Ratios are 0 where undefined, and
    rounded to four digits; f1 is of the unrounded ratios.
    """
    rows = truth.select(*group, *item, F.lit(1).alias("t"), F.lit(0).alias("f")).unionByName(found.select(*group, *item, F.lit(0).alias("t"), F.lit(1).alias("f")))
    items = rows.groupBy(*group, *item).agg(F.max("t").alias("t"), F.max("f").alias("f"))
    counts = items.groupBy(*group).agg(F.sum("t").alias("n_truth"), F.sum("f").alias("n_found"), F.sum(F.col("t") * F.col("f")).alias("n_both"))
    return counts.select(
        *group, "n_truth", "n_found", "n_both", ratio(F.col("n_both"), F.col("n_found")).alias("precision"), ratio(F.col("n_both"), F.col("n_truth")).alias("recall"),
        ratio(2 * F.col("n_both"), F.col("n_truth") + F.col("n_found")).alias("f1"),
    )
