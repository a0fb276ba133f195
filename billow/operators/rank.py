"""First, best and last rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group in an order that must be total. Spark applies the limit before the exchange too,
    so a task sends at most n rows of a group."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which takes the place of the order of lines in a file."""
    return top_per_group(df, key, order, 1)


def best_value(df: DataFrame, group: list[str], value: Column, by: list[Column], alias: str) -> DataFrame:
    """One row a group with the value that is least by `by`; a partial aggregate, so nothing but one candidate leaves
    each task."""
    return df.groupBy(*group).agg(F.min_by(value, F.struct(*by)).alias(alias))


def merged(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """old with `fields` replaced by those of the new row of the same key where they are not null. Keys are unique."""
    fresh = new.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = old.join(fresh, F.col(key) == F.col("__key"), "left")
    return joined.select([F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns])


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in `seen`; a null key is never seen."""
    return df.join(seen.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_anti")


def latest_value(df: DataFrame, group: list[str], value: str, order: list[Column], alias: str) -> DataFrame:
    """One row a group with the value of its last row by `order`; a partial aggregate."""
    return df.groupBy(*group).agg(F.max_by(value, F.struct(*order)).alias(alias))
