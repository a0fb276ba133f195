"""What a classifier said about repositories, checked and flattened; the classifier itself is another tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billow.dims import CATEGORIES
from billow.functions.scalars import comma_list, filled, first_tags, own_framework

#: The columns of a flat record, in order.
FLAT = [
    "id", "owner", "repo", "category", "is_web_application", "is_web_framework", "framework", "framework_version", "stars", "description_zh", "description_en",
    "language", "topics", "tags", "description", "default_branch", "latest_release", "reasoning", "analyzed_at",
]


def records(rows: DataFrame) -> DataFrame:
    """owner, repo, record: what a flat record (all values texts, as in a CSV file) said, as the nested JSON that a cache of
    a classifier's answers holds; missing values are null, tags a list."""
    text = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    record = F.struct(
        "category", text("framework").alias("primary_framework"), text("framework_version").alias("framework_version"),
        F.struct(F.col("description_en").alias("en"), F.col("description_zh").alias("zh")).alias("description"), comma_list(F.col("tags")).alias("tags"), "reasoning",
    )
    return rows.select("owner", "repo", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def adapted(rows: DataFrame) -> DataFrame:
    """rows with owner and name from what a list has: repo_name or repo for a name, 'owner/name' in one field, 'unknown'
    for an owner that nothing tells."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    name = F.coalesce(has("name"), has("repo_name"), has("repo"))
    split = has("owner").isNull() & F.contains(name, F.lit("/"))
    owner = F.when(split, F.substring_index(name, "/", 1)).otherwise(F.coalesce(has("owner"), F.lit("unknown")))
    short = F.when(split, F.expr("substring(__n, instr(__n, '/') + 1)")).otherwise(F.col("__n"))
    return rows.withColumn("__n", name).withColumn("__o", owner).withColumn("name", short).withColumn("owner", F.col("__o")).drop("__n", "__o")


def known_category(category: Column) -> Column:
    """The category, 'Other' for one that is not in the list."""
    return F.when(category.isin(CATEGORIES), category).otherwise(F.lit("Other"))


def flat(rows: DataFrame, frameworks: DataFrame | None = None) -> DataFrame:
    """Columns FLAT from rows(id, owner, repo, stars, language, topics, description, default_branch, latest_release,
    category, tags, description_zh, description_en, reasoning, analyzed_at).

    frameworks(repository_id, framework, version, priority) gives each repository the framework of least priority. A
    web framework is its own; only a web application keeps tags, five at most.
    """
    if frameworks is not None:
        first = frameworks.groupBy(F.col("repository_id").alias("__r")).agg(F.min_by(F.struct("framework", "version"), F.struct("priority", "framework", "version")).alias("__f"))
        joined = rows.join(first, F.col("id") == F.col("__r"), "left")
    else:
        joined = rows.withColumn("__f", F.struct(F.lit(None).cast("string").alias("framework"), F.lit(None).cast("string").alias("version")))
    category = known_category(F.col("category"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined_list = lambda items: F.array_join(F.coalesce(items, F.array().cast("array<string>")), ", ")
    return joined.select(
        "id", "owner", "repo", category.alias("category"), (category == "Web Application").alias("is_web_application"), (category == "Web Framework").alias("is_web_framework"),
        own_framework(category, F.col("repo"), filled(F.col("__f.framework"))).alias("framework"), filled(F.col("__f.version")).alias("framework_version"), "stars",
        text("description_zh").alias("description_zh"), text("description_en").alias("description_en"), text("language").alias("language"), joined_list(F.col("topics")).alias("topics"),
        joined_list(first_tags(category, F.col("tags"))).alias("tags"), text("description").alias("description"), "default_branch", text("latest_release").alias("latest_release"), "reasoning", "analyzed_at",
    ).select(*FLAT)
