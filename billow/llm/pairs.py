"""Items that appear together: heavy-light decomposition of pair counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTS = "space string, a int, b int, n bigint"
#: A block of baskets of one space ends at so many baskets, or at the first basket that brings it to so many rows.
BLOCK, BLOCK_ROWS = 16384, 4_000_000
#: Dense items of a space at the most; what is over it counts as light, which is exact too.
DENSE = 2048
#: Light items in one part of a basket: two parts give at most the square of it in pairs.
PART = 256
#: Pairs that a task keeps before it hands them on.
OUT = 200_000


class Block:
    """Baskets of one space: bit rows of dense items, and for every other item the list of its baskets.

    With h dense items it holds h * BLOCK bytes for probing and an eighth of that in bit rows, at most 32 MB and 4 MB,
    and 8 bytes a row of BLOCK_ROWS; a basket is never divided, so a longer one adds its own rows.
    """

    def __init__(self, space: str):
        self.space = space
        self.baskets = self.rows = 0
        self.slots: list[np.ndarray] = []
        self.items: list[np.ndarray] = []
        self.dense: list[np.ndarray] = []

    def add(self, slots: np.ndarray, items: np.ndarray, dense: np.ndarray) -> None:
        self.slots.append(slots.astype(np.int32))
        self.items.append(items.astype(np.int32))
        self.dense.append(dense)
        self.rows += len(slots)

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, n), a < b, of all pairs with a dense item: popcounts of the conjunction of bit rows for two dense
        ones; a light item probes the dense rows with its list of baskets."""
        if not self.rows:
            return
        slots, items, dense = np.concatenate(self.slots), np.concatenate(self.items), np.concatenate(self.dense)
        heavy = np.unique(items[dense])
        if not len(heavy):
            return
        held = np.zeros((-(-self.baskets // 64) * 64, len(heavy)), bool)
        held[slots[dense], np.searchsorted(heavy, items[dense])] = True
        words = np.packbits(np.ascontiguousarray(held.T), axis=1).view(np.uint64)
        for k in range(len(heavy) - 1):
            both = np.bitwise_count(words[k + 1 :] & words[k]).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(both)
            yield np.full(len(hit), heavy[k]), heavy[k + 1 + hit], both[hit]
        order = np.argsort(items[~dense], kind="stable")
        light, lists = items[~dense][order], slots[~dense][order]
        borders = np.flatnonzero(np.concatenate(([True], light[1:] != light[:-1], [True]))) if len(light) else np.zeros(1, int)
        for begin, end in zip(borders[:-1], borders[1:], strict=True):
            both = held[lists[begin:end]].sum(axis=0, dtype=np.int64)
            hit = np.flatnonzero(both)
            yield np.minimum(heavy[hit], light[begin]), np.maximum(heavy[hit], light[begin]), both[hit]


def count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts of rows (space, basket, item, dense) that come sorted by space and basket, block by block. Memory is
    that of one block and one batch."""
    block: Block | None = None
    last: tuple[str, str] | None = None

    def flush() -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for triple in block.counts() if block is not None else ():
            held.append(triple)
            size += len(triple[0])
            if size >= OUT:
                yield table(held)
                held, size = [], 0
        if size:
            yield table(held)

    def table(held: list) -> pa.RecordBatch:
        a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
        space = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(a), np.int32)), pa.array([block.space])).cast(pa.string())
        return pa.record_batch([space, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], ["space", "a", "b", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        space, basket = batch.column(0), batch.column(1)
        items, dense = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        begins = np.ones(batch.num_rows, bool)
        begins[1:] = pc.or_(pc.not_equal(space[1:], space[:-1]), pc.not_equal(basket[1:], basket[:-1])).to_numpy(zero_copy_only=False)
        begins[0] = last != (space[0].as_py(), basket[0].as_py())
        last = (space[-1].as_py(), basket[-1].as_py())
        # Rows before the first border go on with the basket of the batch before.
        borders = np.append(np.flatnonzero(begins), batch.num_rows)
        if borders[0]:
            block.add(np.full(borders[0], block.baskets - 1), items[: borders[0]], dense[: borders[0]])
        at = 0
        while at < len(borders) - 1:
            name = space[int(borders[at])].as_py()
            if block is None or block.space != name or block.baskets >= BLOCK or block.rows >= BLOCK_ROWS:
                yield from flush()
                block = Block(name)
            # As many baskets as fit, all of this space.
            end = min(len(borders) - 1, at + BLOCK - block.baskets)
            end = max(at + 1, min(end, int(np.searchsorted(borders, borders[at] + BLOCK_ROWS - block.rows, "right")) - 1))
            if space[int(borders[end]) - 1].as_py() != name:
                other = np.flatnonzero(pc.not_equal(space.slice(int(borders[at]), int(borders[end] - borders[at])), name).to_numpy(zero_copy_only=False))
                end = int(np.searchsorted(borders, borders[at] + other[0]))
            begin, stop = int(borders[at]), int(borders[end])
            slots = block.baskets + np.cumsum(begins[begin:stop]) - 1
            block.add(slots, items[begin:stop], dense[begin:stop])
            block.baskets += end - at
            at = end
    yield from flush()


def item_pairs(rows: DataFrame, space: str, basket: str, item: str, least: int = 5, least_share: tuple[int, int] = (2, 100), lift: float = 3.0, dense_share: tuple[int, int] = (5, 100), part: int = PART) -> DataFrame:
    """space, item_a < item_b, baskets_a, baskets_b, both, baskets, lift: pairs of items of one space that occur
    together in at least `least` baskets, at least the share `least_share` of the space's baskets, and at least `lift`
    times as often as chance would have it. Exact.

    An item counts once in a basket. Rows with a null space, basket or item are left out; so are other columns. An
    empty input gives an empty result.

    Only items that reach the least support themselves can be in a pair: at most (100 / 2) * (mean basket) items a
    space, which bounds all that follows. Items are numbered from the most frequent on. Items in at least
    `dense_share` of the baskets, but no more than DENSE of them, are dense: in blocks of baskets they are rows of a bit
    matrix, and their pairs are popcounts. An item that is not dense probes the dense rows with its list of baskets.
    Pairs of two items that are not dense are counted by hash. There a basket comes in parts by the number of the item,
    each of `part` items at the most, and parts meet in pairs, so no row holds more than 2 * `part` items, gives more
    than the square of `part` pairs, or depends on how wide a basket is. Baskets are sent once: blocks and parts read
    the same exchange.
    """
    clean = rows.select(F.col(f"`{space}`").alias("space"), F.col(f"`{basket}`").alias("basket"), F.col(f"`{item}`").alias("name"))
    clean = clean.filter("space IS NOT NULL AND basket IS NOT NULL AND name IS NOT NULL").distinct()
    # Counting the items of a basket keeps the distinct rows below, so this reads the exchange that the others read.
    spaces = clean.groupBy("space", "basket").agg(F.count("*").alias("k")).groupBy("space").agg(F.count_if(F.col("k") > 0).alias("baskets"))
    frequent = (
        clean.groupBy("space", "name").agg(F.count("*").alias("n")).join(spaces, "space")
        .filter((F.col("n") >= least) & (F.col("n") * least_share[1] >= F.col("baskets") * least_share[0]))
        .withColumn("item", F.row_number().over(Window.partitionBy("space").orderBy(F.desc("n"), "name")))
        .withColumn("dense", (F.col("n") * dense_share[1] >= F.col("baskets") * dense_share[0]) & (F.col("item") <= DENSE))
    )
    kept = clean.join(frequent.select("space", "name", "item", "dense"), ["space", "name"]).select("space", "basket", "item", "dense").repartition("space", "basket")
    matrix = kept.sortWithinPartitions("space", "basket").mapInArrow(count_blocks, COUNTS)
    # Not a filter on `dense` before: that would go below the exchange, which blocks and parts would then not share.
    of_part = kept.groupBy("space", "basket", F.floor(F.col("item") / part).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.when(~F.col("dense"), F.col("item")))).alias("items"))
    parts = of_part.filter(F.size("items") > 0)
    other = parts.select("space", "basket", F.col("part").alias("part_b"), F.col("items").alias("items_b"))
    met = parts.join(other, ["space", "basket"]).filter((F.col("part") < F.col("part_b")) | ((F.col("part") == F.col("part_b")) & (F.size("items") > 1)))
    hashed = (
        met.select("space", F.explode("items").alias("a"), "items_b", (F.col("part") == F.col("part_b")).alias("same"))
        .select("space", "a", F.explode(F.when(F.col("same"), F.filter("items_b", lambda x: x > F.col("a"))).otherwise(F.col("items_b"))).alias("b"))
        .groupBy("space", "a", "b").agg(F.count("*").alias("n"))
    )
    counted = matrix.unionByName(hashed.select("space", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n")).groupBy("space", "a", "b").agg(F.sum("n").alias("both"))
    named = frequent.select("space", "item", "name", "n", "baskets")
    left = named.select("space", F.col("item").alias("a"), F.col("name").alias("name_1"), F.col("n").alias("n_1"), "baskets")
    right = named.select("space", F.col("item").alias("b"), F.col("name").alias("name_2"), F.col("n").alias("n_2"))
    pairs = (
        counted.filter(F.col("both") >= least).join(left, ["space", "a"]).join(right, ["space", "b"])
        .filter((F.col("both") * least_share[1] >= F.col("baskets") * least_share[0]) & (F.col("both").cast("double") * F.col("baskets") >= lift * F.col("n_1") * F.col("n_2")))
    )
    swap = F.col("name_1") > F.col("name_2")
    return pairs.select(
        F.col("space").alias(space),
        F.when(swap, F.col("name_2")).otherwise(F.col("name_1")).alias("item_a"),
        F.when(swap, F.col("name_1")).otherwise(F.col("name_2")).alias("item_b"),
        F.when(swap, F.col("n_2")).otherwise(F.col("n_1")).alias("baskets_a"),
        F.when(swap, F.col("n_1")).otherwise(F.col("n_2")).alias("baskets_b"),
        "both",
        "baskets",
        (F.col("both").cast("double") * F.col("baskets") / (F.col("n_1") * F.col("n_2"))).alias("lift"),
    )
