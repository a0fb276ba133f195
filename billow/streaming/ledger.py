"""Ledgers that grow: new rows once, newest versions, and a mark to resume from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from billow.schemas import LEDGER, TABLES
from billow.sources.files import BAD, ledger
from billow.tables import KEYS, newest


def ledger_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """Lines of the JSON files of a folder as they arrive, valid ones only, with aliases resolved."""
    rows = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_a_trigger).option("mode", "DROPMALFORMED").json(folder)
    return ledger(rows.withColumn(BAD, F.lit(None).cast("string")))


def new_rows(rows: DataFrame, key: str = "id", time: str | None = None, delay: str = "7 days") -> DataFrame:
    """The first row of each key over the life of the stream; seen keys are kept in the checkpoint and survive restarts.

    With a time column a key is forgotten once it is older than the delay, which bounds the state.
    """
    if time is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def write_new(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived as JSON lines, exactly once, then stops."""
    return rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends every batch to a versioned Parquet table; readers take the newest row of each key (`current`)."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, table: str) -> DataFrame:
    return newest(spark.read.schema(TABLES[table]).parquet(path), KEYS[table])


def may_stop(rows: DataFrame, least: int) -> bool:
    """Has a ledger already come down to this number of stars? Starts a job for one number."""
    low = rows.agg(F.min("stars").alias("m")).first()["m"]
    return low is not None and low <= least
