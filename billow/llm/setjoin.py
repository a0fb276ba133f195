"""All similar pairs between set-valued records: extended prefixes, joined on combinations of tokens."""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billow.session import cut

#: Tokens that a combination has at the most, and combinations that a record writes into a size class at the most.
LONGEST, MOST = 3, 512
#: A candidate costs so many times what a written combination does: it is made distinct and meets two whole sets.
CANDIDATE = 2.0


@dataclass(frozen=True)
class SimilarSets:
    """links(rep_a < rep_b, shared, together): similar pairs of different sets, each set standing for its class of equal
    ones by its least record. members(rep, record, size): every record with its class."""

    links: DataFrame
    members: DataFrame


def token_sets(pairs: DataFrame, record: str, token: str) -> DataFrame:
    """record, tokens: the distinct tokens of each record as whole numbers, rarest first in the whole collection.

    Null records and tokens are left out. Ids follow (frequency, token), so they are the global order that prefixes
    need, and sets of whole numbers are cheap to compare. Both uses of the distinct rows share one exchange.
    """
    rows = pairs.select(F.col(f"`{record}`").alias("record"), F.col(f"`{token}`").alias("token")).filter("record IS NOT NULL AND token IS NOT NULL").distinct()
    ids = rows.groupBy("token").agg(F.count("*").alias("df")).orderBy("df", "token").select("token", F.monotonically_increasing_id().alias("id"))
    return rows.join(ids, "token").groupBy("record").agg(F.array_sort(F.collect_list("id")).alias("tokens"))


def group_of(size: Column, share: tuple[int, int]) -> Column:
    """Size classes that grow by 1/share, so that a partner lies in the same class or the one beside it."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(share[1] / share[0])) + 1e-9).cast("int")


def least_overlap(size: Column, share: tuple[int, int]) -> Column:
    """The least overlap with any similar partner, the share of the size, rounded up; in whole numbers."""
    return ((size * share[0] + (share[1] - 1)) / share[1]).cast("int")


def combinations(tokens: Column, length: int) -> Column:
    """Hashes of all ascending combinations of `length` tokens. Equal combinations have equal hashes; different ones
    that collide only add a candidate, which the check of the overlap drops."""
    if length == 1:
        return F.transform(tokens, lambda a: F.xxhash64(a))

    def rest(position: Column) -> Column:
        return F.slice(tokens, position + 2, F.size(tokens))

    if length == 2:
        return F.flatten(F.transform(tokens, lambda a, i: F.transform(rest(i), lambda b: F.xxhash64(a, b))))
    return F.flatten(
        F.flatten(F.transform(tokens, lambda a, i: F.transform(rest(i), lambda b, j: F.transform(F.slice(tokens, i + j + 3, F.size(tokens)), lambda c: F.xxhash64(a, b, c)))))
    )


def in_classes(sets: DataFrame, share: tuple[int, int], upper: bool) -> DataFrame:
    """sets with size, own (its size class), class: own, and if `upper` each class below that a smaller partner may have."""
    size = F.size("tokens")
    own = group_of(size, share)
    each = F.explode(F.sequence(group_of(least_overlap(size, share), share), own)) if upper else own
    return sets.select("rep", "tokens", size.alias("size"), own.alias("own"), each.alias("class"))


def signatures(sets: DataFrame, share: tuple[int, int], lengths: Column, upper: bool) -> DataFrame:
    """rep, size, own, class, sig of each record: its combinations in its own class (upper: also in the classes below).
    lengths: how many tokens are combined in a class, by the column `class`."""
    rows = in_classes(sets, share, upper).withColumn("l", lengths)
    prefix = F.slice("tokens", F.lit(1), F.least("size", F.col("size") - least_overlap(F.col("size"), share) + F.col("l")))
    several = F.when(F.col("l") == 1, combinations(prefix, 1)).when(F.col("l") == 2, combinations(prefix, 2)).otherwise(combinations(prefix, 3))
    return rows.select("rep", "size", "class", "own", F.explode(several).alias("sig"))


def allowed_lengths(group: int, share: tuple[int, int]) -> list[int]:
    """The lengths that a size class may have: 1, and more as long as no record writes over MOST combinations into the
    class, the largest being a partner from a class above, and its smallest sets are sure to share that many tokens."""
    least = max(1, int((share[1] / share[0]) ** group * (1 - 1e-9)))
    largest = int((share[1] / share[0]) ** (group + 1) * (1 + 1e-9)) * share[1] // share[0] + 1
    prefix = lambda size: size - -(-size * share[0] // share[1])
    return [n for n in range(1, LONGEST + 1) if n == 1 or (comb(prefix(largest) + n, n) <= MOST and -(-least * share[0] // share[1]) >= n)]


def prefix_lengths(sets: DataFrame, share: tuple[int, int]) -> dict[int, int]:
    """How many shared prefix tokens to ask for in each size class; starts one job, with a row a class to the driver.

    Nothing is expanded to learn it: counted are the records of a class that have a token in their prefix, for each
    length. From the sum of squares follows how many records share a token of a prefix by chance, from that how many
    share several. The length with the least sum of combinations written and candidates expected is taken, among those
    `allowed_lengths` gives. This chooses the cost, never the result.
    """
    extra = F.greatest(F.lit(0), F.col("k") - (F.col("size") - least_overlap(F.col("size"), share)))
    exploded = in_classes(sets, share, upper=True).select("class", "rep", "size", F.posexplode(F.slice("tokens", F.lit(1), F.col("size") - least_overlap(F.col("size"), share) + LONGEST)).alias("k", "token"))
    postings = exploded.withColumn("extra", extra).groupBy("class", "token").agg(F.count_if(F.col("k") == 0).alias("records"), *[F.count_if(F.col("extra") < n).cast("double").alias(f"n{n}") for n in range(1, LONGEST + 1)])
    sums = [x for n in range(1, LONGEST + 1) for x in (F.sum(f"n{n}").alias(f"t{n}"), F.sum(F.col(f"n{n}") ** 2).alias(f"p{n}"))]
    chosen: dict[int, int] = {}
    for row in postings.groupBy("class").agg(F.sum("records").alias("records"), *sums).collect():
        records, best = max(1, row["records"]), None
        for n in allowed_lengths(row["class"], share):
            tokens = row[f"t{n}"] / records
            ways, by_chance = 1.0, row[f"p{n}"] / row[f"t{n}"] / records
            for k in range(n):
                ways *= max(tokens - k, 0.5) / (k + 1)
            cost = records * ways + CANDIDATE * records * records * ways * by_chance**n
            if best is None or cost < best[0]:
                best = (cost, n)
        chosen[row["class"]] = best[1]
    return chosen


def similar_classes(sets: DataFrame, share: tuple[int, int] = (4, 5)) -> SimilarSets:
    """Classes of equal sets, and the pairs of classes with shared / together >= share[0] / share[1], exactly. `sets`
    comes from `token_sets`; records are unique and of any type that can be ordered.

    A third of all records being copies costs one class. Classes emit combinations of the tokens of an extended
    prefix, one, two or three by size class (see `prefix_lengths`); two similar sets share the first of them for
    certain. No record writes more than MOST combinations into a size class: larger sets join on single tokens of the
    plain prefix, which are no more than the set has, so nothing is lost. The smaller set's class is where a pair
    meets, so each pair is joined in one class only. Candidates are made distinct, then checked on whole sets.

    The sets are written to the checkpoint folder first: they are read several times, and the numbers of their tokens
    must be the same each time.
    An empty input gives an empty result; a record with a null or empty set is in no class.
    """
    rows = cut(sets.filter(F.size("tokens") > 0))
    classes = rows.groupBy("tokens").agg(F.min("record").alias("rep"))
    lengths = prefix_lengths(classes, share)
    pick = F.lit(1)
    for group, length in lengths.items():
        pick = F.when(F.col("class") == group, length).otherwise(pick)
    home = signatures(classes, share, pick, upper=False).select(F.col("rep").alias("a"), F.col("size").alias("size_a"), F.col("class").alias("ca"), F.col("sig").alias("sa"))
    away = signatures(classes, share, pick, upper=True).select(F.col("rep").alias("b"), F.col("size").alias("size_b"), F.col("class").alias("cb"), F.col("own").alias("ob"), F.col("sig").alias("sb"))
    met = home.join(away, (F.col("ca") == F.col("cb")) & (F.col("sa") == F.col("sb")))
    once = F.when(F.col("ob") == F.col("cb"), F.col("a") < F.col("b")).otherwise(F.lit(True))
    fits = F.least("size_a", "size_b") * share[1] >= F.greatest("size_a", "size_b") * share[0]
    candidates = met.filter(once & fits).select("a", "b").distinct()
    left = classes.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    right = classes.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    checked = candidates.join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), (F.size("ta") + F.size("tb") - shared).alias("together"))
    links = checked.filter(F.col("shared") * share[1] >= F.col("together") * share[0]).select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b"), "shared", "together")
    return SimilarSets(links, rows.join(classes, "tokens").select("rep", "record", F.size("tokens").alias("size")))


def expanded(found: SimilarSets) -> DataFrame:
    """record_a < record_b, shared, together: every pair of records, copies included. A class of k copies gives all its
    k (k - 1) / 2 pairs, so use it where the result is defined so; `record_links` says the same in one row a record."""
    copies = found.members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep")
    several = found.members.join(copies, "rep", "left_semi")
    inside = (
        several.select("rep", F.col("record").alias("record_a"), F.col("size").alias("shared"), F.col("size").alias("together"))
        .join(several.select("rep", F.col("record").alias("record_b")), "rep").filter(F.col("record_a") < F.col("record_b"))
        .select("record_a", "record_b", "shared", "together")
    )
    of = lambda rep, name: found.members.select(F.col("rep").alias(rep), F.col("record").alias(name))
    between = (
        found.links.join(of("rep_a", "x"), "rep_a").join(of("rep_b", "y"), "rep_b")
        .select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"), "shared", "together")
    )
    return between.unionByName(inside)


def record_links(found: SimilarSets) -> DataFrame:
    """record, rep, links: the class of every record and with how many other records it is similar, copies included."""
    sizes = found.members.groupBy("rep").agg(F.count("*").alias("n"))
    ends = found.links.select("rep_a", "rep_b").unionByName(found.links.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
    others = ends.join(sizes.select(F.col("rep").alias("rep_b"), "n"), "rep_b").groupBy(F.col("rep_a").alias("rep")).agg(F.sum("n").alias("others"))
    counts = sizes.join(others, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return found.members.join(counts, "rep").select("record", "rep", "links")


def similar_pairs(sets: DataFrame, share: tuple[int, int] = (4, 5), least: int = 1) -> DataFrame:
    """record_a < record_b, shared, together: all similar pairs of records whose sets have at least `least` tokens. See
    `similar_classes` and `expanded`."""
    return expanded(similar_classes(sets.filter(F.size("tokens") >= least), share))
