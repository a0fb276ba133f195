"""Per-key results where a few keys hold most rows: eager aggregation through a join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EagerJoin:
    """Counts of two inputs and of their join, by group and by join key. See `eager_join`. `rolled` holds both: left_out
    is 2 for a row of a group and 1 for one of a key; n, m, pairs are the counts, null for none. `sums` is one row with
    the rows of either input (left_rows, right_rows)."""

    groups: DataFrame
    keys: DataFrame
    rolled: DataFrame
    sums: DataFrame


def counted(df: DataFrame, by: dict[str, F.Column], weight: F.Column | None = None) -> DataFrame:
    """The compact state of an input: one row (by..., n) of each combination; nulls are values of their own."""
    return df.select(*[c.alias(name) for name, c in by.items()], (F.lit(1).cast("bigint") if weight is None else weight).alias("w")).groupBy(*by).agg(F.sum("w").alias("n"))


def eager_join(left: DataFrame, right: DataFrame, left_on: F.Column, right_on: F.Column, group: F.Column) -> EagerJoin:
    """Row counts by a group of the left input and by the join key, and how many rows the join would have.

    groups(group, n, pairs): n rows of the left input, pairs rows of left JOIN right.
    keys(key, n_left, n_right, pairs): the same by join key, for keys of either input.

    Neither input is joined row by row. Both are aggregated by join key first (the left one by key and group), so each
    task sends at most one row of a combination, however many rows a hot key has. The compact states are joined, the
    counts multiplied, then rolled up to groups and to keys in one aggregate over both grouping sets, so each input is
    read and sent once. A hot key meets one row of the right state, and what is left of skew on the left is one row for
    each group of the key, which adaptive execution splits, the join being a left one; keys that only the right input
    has come in by a union with its state.

    A null join key matches nothing: pairs is 0, but its rows count. Null groups are one group. Empty inputs give
    empty results. Repeated rows count as often as they occur; remove them first if they should not.
    """
    by_key_group = counted(left, {"key": left_on, "group": group})
    by_key = counted(right, {"key": right_on}).select("key", F.col("n").alias("m"))
    # Null meets null here and counts no pair: a join that leaves null out would put a filter on one use of the right
    # state only, and its input would be read twice.
    a, b = by_key_group.alias("a"), by_key.alias("b")
    joined = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")), "left").select("a.key", "group", "n", "m")
    state = joined.unionByName(by_key.select("key", F.lit(None).cast(joined.schema["group"].dataType).alias("group"), F.lit(None).cast("bigint").alias("n"), "m"))
    # 1 is the bit of a column that a grouping set leaves out, the last column's being the lowest.
    state = state.withColumn("p", F.when(F.col("key").isNotNull(), F.col("n") * F.coalesce("m", F.lit(0))))
    rolled = state.groupingSets([["key"], ["group"]], "key", "group").agg(
        F.grouping_id().alias("left_out"), F.sum("n").alias("n"), F.max("m").alias("m"), F.sum("p").alias("pairs")
    )
    groups = rolled.filter("left_out = 2 AND n IS NOT NULL").select("group", "n", F.coalesce("pairs", F.lit(0)).alias("pairs"))
    keys = rolled.filter("left_out = 1").select("key", *[F.coalesce(c, F.lit(0)).alias(name) for c, name in (("n", "n_left"), ("m", "n_right"), ("pairs", "pairs"))])
    sums = by_key_group.agg(F.sum("n").alias("left_rows")).join(F.broadcast(by_key.agg(F.sum("m").alias("right_rows"))))
    return EagerJoin(groups, keys, rolled, sums)


def heavy(joined: EagerJoin, share: tuple[int, int] = (3, 100)) -> DataFrame:
    """group or key (the other is null), left_out: groups whose n is at least share[0]/share[1] of the sum of n over all
    groups, and keys whose rows on the right are that part of all rows on the right; null groups and keys count in the
    sums only.

    The sums are one row, so they are joined as a broadcast; they come from the exchanges of the compact states, which
    the join reads too. Exact: whole numbers only. The test is one expression that Catalyst cannot take apart, as a
    filter pushed to the scan of one branch would have everything below read and sent twice.
    """
    rolled = joined.rolled.select("key", "group", "left_out", F.when(F.col("left_out") == 2, F.col("n")).otherwise(F.col("m")).alias("rows"))
    total = F.when(F.col("left_out") == 2, F.col("left_rows")).otherwise(F.col("right_rows"))
    named = F.when(F.col("left_out") == 2, F.col("group").isNotNull()).otherwise(F.col("key").isNotNull())
    return rolled.join(F.broadcast(joined.sums)).filter(F.when(named, F.col("rows") * share[1] >= total * share[0]).otherwise(F.lit(False))).select("key", "group", "left_out", "rows")
