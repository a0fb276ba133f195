"""Problem 1: names and repositories that hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billow.operators.skew import EagerJoin, eager_join, heavy
from billow.tables import KEYS, fold, load


def states(spark: SparkSession, folder: str) -> EagerJoin:
    """Artifacts and releases, one row of each table key, joined on the repository.

    The folded name is a function of the artifact's key, so the newest row of a key has it like all others, and
    distinct keys stand for newest rows without sorting by version.
    """
    artifacts = load(spark, folder, "artifacts").select(*KEYS["artifacts"]).distinct()
    releases = load(spark, folder, "releases").select(*KEYS["releases"]).distinct()
    return eager_join(artifacts, releases, artifacts["repository_id"], releases["repository_id"], fold(artifacts["name"]))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    of_name = F.col("left_out") == 2
    field = F.when(of_name, "artifacts.name").otherwise("releases.repository_id")
    return heavy(states(spark, folder)).select(field.alias("field"), F.when(of_name, F.col("group")).otherwise(F.col("key").cast("string")).alias("key_value"))


def p1_name_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Of every folded name: newest artifact rows, and rows of their join with newest releases on the repository."""
    return states(spark, folder).groups.filter("group IS NOT NULL").select(F.col("group").alias("name"), F.col("n").alias("artifact_rows"), F.col("pairs").alias("release_pairs"))


def p1_repository_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Of every repository: newest artifact rows, newest release rows, rows of their join."""
    return states(spark, folder).keys.select(F.col("key").alias("repository_id"), F.col("n_left").alias("artifact_rows"), F.col("n_right").alias("release_rows"), F.col("pairs").alias("joined_rows"))


FOLD = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), '')"
NEWEST = f"""
WITH a AS (SELECT DISTINCT repository_id, artifact_id, name, version, sbom_commit_sha FROM artifacts),
     r AS (SELECT DISTINCT repository_id, tag_name FROM releases),
     an AS (SELECT {FOLD.format("name")} AS name, repository_id FROM a),
     rn AS (SELECT repository_id, count(*) AS m FROM r GROUP BY repository_id)
"""

QUERIES = {"p1_found": p1_found, "p1_name_counts": p1_name_counts, "p1_repository_counts": p1_repository_counts}
SQL = {
    "p1_found": NEWEST
    + """SELECT 'artifacts.name' AS field, name AS key_value FROM an WHERE name IS NOT NULL GROUP BY name
         HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM an)
         UNION ALL SELECT 'releases.repository_id', CAST(repository_id AS VARCHAR) FROM r WHERE repository_id IS NOT NULL
         GROUP BY repository_id HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM r)""",
    "p1_name_counts": NEWEST
    + """SELECT an.name, count(*) AS artifact_rows, CAST(sum(coalesce(m, 0)) AS BIGINT) AS release_pairs
         FROM an LEFT JOIN rn ON an.repository_id = rn.repository_id WHERE an.name IS NOT NULL GROUP BY an.name""",
    "p1_repository_counts": NEWEST
    + """, ac AS (SELECT repository_id, count(*) AS n FROM a GROUP BY repository_id)
         SELECT coalesce(ac.repository_id, rn.repository_id) AS repository_id, coalesce(n, 0) AS artifact_rows,
                coalesce(m, 0) AS release_rows, coalesce(n * m, 0) AS joined_rows
         FROM ac FULL JOIN rn ON ac.repository_id = rn.repository_id""",
}
