"""Sessions, lineage cuts and size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold on a laptop and on a cluster alike. The number of shuffle partitions is the starting number:
#: adaptive execution joins small ones and splits skewed ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_made: dict[str, str] = {}


def session(master: str = "local[*]", name: str = "billow", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and for one machine; on a cluster the launcher sets master and memory."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only where that is unset and all runs on one
    machine, as in tests, a temporary folder is made, which goes when Python ends."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _made:
            _made[context.applicationId] = tempfile.mkdtemp(prefix="billow-")
            atexit.register(shutil.rmtree, _made[context.applicationId], ignore_errors=True)
        folder = _made[context.applicationId]
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder, for files that a query writes and reads again."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back, so that what follows does not compute it again.

    Starts a job. Reliable: the files outlive executors. They are deleted when the DataFrame is no longer referred to,
    if spark.cleaner.referenceTracking.cleanCheckpoints is on, as in DEFAULTS; a launcher of its own should set it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, limit: int) -> list | None:
    """The rows of df if there are at most `limit` of them, else None. Starts a job that stops after limit + 1 rows."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, split by a unique key over all cores if it comes in fewer parts than there are cores, else as it is.

    For steps whose work a row is far more than moving it: a small table in one file would run on one core. A large
    table comes in many parts and is not moved. What has been through an exchange is spread already and stays as it is:
    to count its parts would run its stages.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
