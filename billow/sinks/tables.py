"""Warehouse tables and the files of the stages."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billow.functions.scalars import python_bool
from billow.operators.rank import keep_first, unseen
from billow.schemas import TABLES
from billow.sources.files import NO_VALUE, TREE, exists, json_lines, machine_folder


def create_tables(spark: SparkSession, database: str) -> None:
    """The database and the three tables, where they are missing. Tables are kept sorted by repository when written, so
    that min and max of a file's row groups let a reader skip them."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def reset_tables(spark: SparkSession, database: str) -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
    create_tables(spark, database)


def append(df: DataFrame, database: str, table: str) -> None:
    """Adds rows; newer versions of a key are added beside older ones, readers see the newest."""
    key = "id" if table == "repositories" else "repository_id"
    df.select(*TABLES[table].names).sortWithinPartitions(key).write.mode("append").insertInto(f"{database}.{table}")


def compact(df: DataFrame, path: str, table: str) -> None:
    """Writes the newest rows as a new copy, sorted by repository in files that Spark splits by range."""
    key = "id" if table == "repositories" else "repository_id"
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def append_ledger(df: DataFrame, path: str, key: str, order: list[Column], force: bool = False) -> None:
    """Adds rows to a JSON-lines ledger: the first of each key, and none that the ledger has (force: even then, for a
    reader that keeps the last). Nulls are left out of the lines."""
    first = keep_first(df, [key], order)
    if exists(df.sparkSession, path) and not force:
        first = unseen(first, json_lines(df.sparkSession, path, df.select(key).schema).select(key), key)
    first.write.mode("append").option("ignoreNullFields", True).json(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A CSV folder with a header and flags as True and False; `single` asks for one file, which only a report of bounded
    size should be: all its rows go through one task."""
    text = df.select([python_bool(F.col(c)).alias(c) if kind == "boolean" else F.col(c) for c, kind in df.dtypes])
    (text.coalesce(1) if single else text).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_trees(paths: DataFrame, root: str) -> None:
    """One text folder for each of language, owner, repo, ref and sha; paths(language, owner, repo, ref, sha, path).

    Each tree is written once, by one task. Where the machines reach the folder by their own file system, tasks write the
    files themselves: without its native library Hadoop takes many milliseconds a file there, as it starts programs for the
    permissions, and the driver moves files one by one. All is written beside the folder, which is replaced when it is whole.
    """
    spark = paths.sparkSession
    whole = paths.select(*[F.coalesce(c, F.lit("")).alias(c) for c in TREE], F.col("path").alias("value")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *TREE)
    folder = machine_folder(spark, root)
    if folder is None:
        whole.write.mode("overwrite").partitionBy(*TREE).text(root)
        return
    made = f"{os.path.dirname(folder)}/.{os.path.basename(folder)}-{uuid.uuid4().hex}"
    Path = spark._jvm.org.apache.hadoop.fs.Path
    old, new = Path(f"file://{folder}"), Path(f"file://{made}")
    system = new.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(new)
    try:
        rows = whole.sortWithinPartitions(*TREE).select([F.col(c).cast("binary").alias(c) for c in [*TREE, "value"]])
        rows.mapInArrow(_tree_writer(os.fsencode(made)), "trees bigint").agg(F.sum("trees")).collect()
        system.create(Path(new, "_SUCCESS")).close()
    except BaseException:
        system.delete(new, True)
        raise
    system.delete(old, True)
    if not system.rename(new, old):
        raise OSError(f"{made} is whole, but cannot become {folder}")


def _tree_writer(root: bytes):
    """A function of batches of rows sorted by tree, which writes a file for each tree and gives the number of trees."""
    signs = re.compile(rb"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")  # as Spark names folders of partitions

    def folder_of(keys: tuple[bytes, ...]) -> bytes:
        values = [signs.sub(lambda m: b"%%%02X" % m[0][0], k) or NO_VALUE for k in keys]
        return b"/".join([root, *[c.encode() + b"=" + v for c, v in zip(TREE, values)]])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file, folder, trees = None, None, b"", 0
        unfinished = b".part-" + uuid.uuid4().hex.encode()  # another attempt of this task has a name of its own

        def end() -> None:
            if file:
                file.close()
                os.replace(folder + b"/" + unfinished, folder + b"/part-00000.txt")

        for batch in batches:
            for *keys, value in zip(*(c.to_pylist() for c in batch.columns)):
                if keys != at:
                    end()
                    at, folder, trees = keys, folder_of(keys), trees + 1
                    os.makedirs(folder, exist_ok=True)
                    file = open(folder + b"/" + unfinished, "wb")  # noqa: SIM115 - closed by end
                file.write((value or b"") + b"\n")
        end()
        yield pa.RecordBatch.from_arrays([pa.array([trees], pa.int64())], ["trees"])

    return write


def as_json(df: DataFrame) -> DataFrame:
    """One column `value`: each row as a JSON object."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
