"""Reading tables, folding names, and the newest row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blanks, tabs and line breaks.
WHITE = " \t\n\r\x0b\x0c"

KEYS = {
    "repositories": ["id"],
    "artifacts": ["repository_id", "artifact_id", "name", "version", "sbom_commit_sha"],
    "releases": ["repository_id", "tag_name"],
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(value: Column | str) -> Column:
    """Without white space at both ends, in lower case; null for what folds to nothing."""
    value = F.col(value) if isinstance(value, str) else value
    return F.nullif(F.lower(F.trim(value, F.lit(WHITE))), F.lit(""))


def blank(value: Column | str) -> Column:
    """True for null, '' and white space only."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.trim(value, F.lit(WHITE)), F.lit("")) == ""


def newest(df: DataFrame, key: list[str], version: str = "updated_at", ties: list[str] | None = None) -> DataFrame:
    """One row of each key: the one with the greatest version, null versions last.

    Nulls in the key are a value of their own. Equal versions are told apart by `ties`, descending, by default by all
    other columns that can be ordered, so the result does not depend on the order of rows. The rank limit is applied
    on both sides of the exchange, so a key with very many rows sends one row from each task.
    """
    if ties is None:
        ties = [f.name for f in df.schema.fields if f.name not in {*key, version} and "map<" not in f.dataType.simpleString()]
    order = [F.col(f"`{c}`").desc_nulls_last() for c in [version, *ties]]
    rank = "__newest"
    window = Window.partitionBy(*[F.col(f"`{c}`") for c in key]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)
