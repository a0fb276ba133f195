"""Projects with the framework that their packages show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billow.plans.warehouse import Warehouse


def projects(warehouse: Warehouse, web_only: bool = False) -> DataFrame:
    """One row a repository with the columns of PROJECTS, most stars first; framework is the first of the language's
    frameworks, by priority, of which the repository has a package, '' if none.

    Artifacts meet the package dimension before anything is sent, so what is sent and joined is one row a repository
    and language, not one a package. The language is written in lower case.
    """
    marks = warehouse.core_packages().select("language", "framework", F.col("package_name").alias("name"), "priority")
    hits = warehouse.tagged(marks, "repository_id")
    first = hits.groupBy("repository_id", F.col("language").alias("l")).agg(F.min_by("framework", F.struct("priority", "framework")).alias("found"))
    rows = warehouse.final("repositories", "id", "language", "owner", "repo", "stars", "default_branch", "latest_release_tag", "sbom_commit_sha", "url")
    joined = rows.join(first, (F.col("id") == F.col("repository_id")) & (F.lower("language") == F.col("l")), "left").withColumn("framework", F.coalesce("found", F.lit("")))
    if web_only:
        joined = joined.filter("framework <> ''")
    return joined.orderBy(F.desc("stars"), "id").select(F.lower("language").alias("language"), "framework", "owner", "repo", "stars", "default_branch", F.col("latest_release_tag").alias("latest_release"), F.col("sbom_commit_sha").alias("commit_sha"), "url")
