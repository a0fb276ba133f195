"""How often every term occurs and in how many records, by an external sort and run-length scanning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS = "field string, term string, occurrences bigint, records bigint"


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal (field, term) in sorted rows (field, term, n): one row a run with the sum of n and the number of
    rows. A run goes on over the border of batches; only the last run of a batch is held back."""
    names = ["field", "term", "occurrences", "records"]
    held: tuple[str, str, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        field, term, n = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        begins = np.ones(len(n), bool)
        begins[1:] = pc.or_(pc.not_equal(field[1:], field[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(begins)
        sums, sizes = np.add.reduceat(n, starts), np.diff(np.append(starts, len(n)))
        first = (field[starts[0]].as_py(), term[starts[0]].as_py())
        out = []
        if held is not None and held[:2] == first:
            sums[0] += held[2]
            sizes[0] += held[3]
        elif held is not None:
            out.append(held)
        at = pa.array(starts[:-1])
        held = (field[starts[-1]].as_py(), term[starts[-1]].as_py(), int(sums[-1]), int(sizes[-1]))
        before = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
        within = [pc.take(field, at), pc.take(term, at), pa.array(sums[:-1], pa.int64()), pa.array(sizes[:-1], pa.int64())]
        yield pa.record_batch([pa.concat_arrays(x) for x in zip(before, within, strict=True)], names)
    if held is not None:
        yield pa.record_batch([pa.array([x]) for x in held], names)


def counted_pairs(pairs: DataFrame, field: str, term: str, record: str) -> DataFrame:
    """field, term, record, n: each different row once with its number. Rows with a null in any of the three are left
    out, other columns ignored. Equal rows are counted in each task before anything is sent."""
    rows = pairs.select(F.col(f"`{field}`").alias("field"), F.col(f"`{term}`").alias("term"), F.col(f"`{record}`").alias("record"))
    return rows.filter("field IS NOT NULL AND term IS NOT NULL AND record IS NOT NULL").groupBy("field", "term", "record").agg(F.count("*").alias("n"))


def term_frequencies(counted: DataFrame) -> DataFrame:
    """field, term, occurrences, records of `counted_pairs`: how often each term occurs and in how many records.

    Repeated rows count as occurrences; an empty input gives an empty result.

    Copies, however many, are one row with their number. The distinct pairs are split by range of (field, term, record)
    and each range is sorted, spilling to disk if need be: a hot term covers as many ranges as its records ask for.
    Runs are scanned batch by batch in constant memory; a term that goes over the border of ranges gives a row in each,
    and these few are added. Nothing here depends on the order or place of rows, so a stage that is run again after a
    loss gives the same.
    """
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(parts, "field", "term", "record").sortWithinPartitions("field", "term", "record")
    runs = ranged.select("field", "term", "n").mapInArrow(scan_runs, RUNS)
    return runs.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def field_sizes(counted: DataFrame) -> DataFrame:
    """field, total: the records that have any term of the field. It asks for n too, so that it reads the exchange that
    `term_frequencies` reads and not the input once more."""
    return counted.filter("n > 0").select("field", "record").groupBy("field", "record").agg(F.count("*").alias("k")).groupBy("field").agg(F.count_if(F.col("k") > 0).alias("total"))


def marks(frequencies: DataFrame, sizes: DataFrame, least: int = 3, most: tuple[int, int] = (20, 100)) -> DataFrame:
    """frequencies with mark: 'rare' under `least` records, else 'common' over the share `most` of the field's
    records, else null. sizes(field, total) has one row a field and is joined as a broadcast: fields are few by
    construction, being literals of the query."""
    mark: Column = F.when(F.col("records") < least, "rare").when(F.col("records") * most[1] > F.col("total") * most[0], "common")
    return frequencies.join(F.broadcast(sizes), "field").withColumn("mark", mark).drop("total")
