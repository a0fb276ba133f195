"""Is a file what a stage expects? Each check reads one line or one file, never a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from billow.sources.files import exists

#: Fields that a line of a repository list must have. Fixed.
LIST_FIELDS = ["id", "owner", "name", "stargazers_count", "html_url", "created_at"]


def list_problems(spark: SparkSession, path: str, fields: list[str] | None = None) -> list[str]:
    """What is wrong with a repository list by its first line; [] if nothing."""
    if not exists(spark, path):
        return ["no such file"]
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0]["value"].strip():
        return ["empty"]
    keys = spark.createDataFrame([(first[0]["value"],)], "line string").select(F.json_object_keys("line").alias("k")).first()["k"]
    if keys is None:
        return ["the first line is no JSON object"]
    return [f"no field {name}" for name in fields or LIST_FIELDS if name not in keys]


def sbom_problems(spark: SparkSession, path: str) -> DataFrame:
    """file, problem of every SBOM file under a folder that is no JSON object or has neither artifacts nor components."""
    rows = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.json_object_keys("value").alias("k"))
    problem = F.when(F.col("k").isNull(), "no JSON object").when(~F.arrays_overlap("k", F.array(F.lit("artifacts"), F.lit("components"))), "neither artifacts nor components")
    return rows.select("file", problem.alias("problem")).filter("problem IS NOT NULL")


def layout_problems(files: DataFrame, root: str) -> DataFrame:
    """Paths of binaryFile rows that do not lie three folders deep or more under `root` (language, owner, repo)."""
    below = F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select("path").filter(F.size(F.split(below, "/")) < 4)


def observed(df: DataFrame, name: str, **counters: F.Column) -> tuple[DataFrame, Observation]:
    """df with counters that are filled while it is computed, at no cost of another pass; read them with .get."""
    watch = Observation(name)
    return df.observe(watch, *[c.alias(k) for k, c in counters.items()]), watch
