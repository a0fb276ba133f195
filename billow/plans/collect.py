"""Merging what is collected about a repository: releases, refs, manifests, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billow.functions.scalars import filled, ref_name
from billow.operators.rank import top_per_group


def merged_releases(releases: DataFrame, tags: DataFrame) -> DataFrame:
    """Releases and, as entries of their own, tags that have no release.

    releases(repository_id, tag_name, name, is_prerelease, is_draft, published_at, created_at, target_commitish),
    tags(repository_id, tag_name, sha, date). Adds source.
    """
    extra = tags.join(releases.select("repository_id", "tag_name"), ["repository_id", "tag_name"], "left_anti")
    columns = ["repository_id", "tag_name", "name", "is_prerelease", "is_draft", "published_at", "created_at", "target_commitish"]
    made = extra.select("repository_id", "tag_name", F.col("tag_name").alias("name"), F.lit(False).alias("is_prerelease"), F.lit(False).alias("is_draft"), F.col("date").alias("published_at"), F.col("date").alias("created_at"), F.col("sha").alias("target_commitish"))
    return releases.select(*columns).withColumn("source", F.lit("github_release")).unionByName(made.withColumn("source", F.lit("git_tag")))


def release_order() -> list[Column]:
    """Newest first by publication, else creation; undated last; then by tag."""
    return [F.coalesce("published_at", "created_at").desc_nulls_last(), F.asc("tag_name")]


def release_summary(entries: DataFrame) -> DataFrame:
    """repository_id, total_releases, has_releases, latest_tag, latest_published: of the newest entry that is neither
    prerelease nor draft. One aggregate: counts and the best entry are partial sums in each task."""
    stable = ~F.coalesce("is_prerelease", F.lit(False)) & ~F.coalesce("is_draft", F.lit(False))
    when = F.coalesce("published_at", "created_at")
    # The least tag among those of the greatest time: negated time orders first, undated entries last.
    key = F.struct(when.isNull(), -F.coalesce(F.unix_micros(when), F.lit(0)), F.col("tag_name"))
    best = F.min_by(F.struct("tag_name", when.alias("at")), F.when(stable, key))
    out = entries.groupBy("repository_id").agg(F.count("*").alias("total_releases"), best.alias("best"))
    return out.select("repository_id", "total_releases", (F.col("total_releases") > 0).alias("has_releases"), F.coalesce("best.tag_name", F.lit("")).alias("latest_tag"), F.col("best.at").alias("latest_published"))


def latest_stable(entries: DataFrame) -> DataFrame:
    """The whole newest entry of each repository that is neither prerelease nor draft."""
    stable = entries.filter(~F.coalesce("is_prerelease", F.lit(False)) & ~F.coalesce("is_draft", F.lit(False)))
    return top_per_group(stable, ["repository_id"], release_order(), 1)


def refs_of_lines(lines: DataFrame, key: list[str], line: str = "value") -> DataFrame:
    """key, ref, sha from lines '<sha> <ref>'. A peeled tag (ref^{}) gives its ref's sha. Lines that are none are left out."""
    parts = lines.select(*key, F.regexp_extract(line, r"^\s*([0-9a-fA-F]+)\s+(\S+)\s*$", 1).alias("sha"), F.regexp_extract(line, r"^\s*([0-9a-fA-F]+)\s+(\S+)\s*$", 2).alias("full")).filter("sha <> ''")
    peeled = F.col("full").endswith("^{}")
    return parts.withColumn("ref", F.regexp_replace("full", r"\^\{\}$", "")).groupBy(*key, "ref").agg(F.max_by("sha", F.struct(peeled, F.col("sha"))).alias("sha"))


def tags_of_refs(refs: DataFrame, key: list[str]) -> DataFrame:
    """key, tag_name, sha of refs under refs/tags/ only: branches and HEAD are no tags."""
    return refs.filter(F.col("ref").startswith("refs/tags/")).select(*key, ref_name(F.col("ref")).alias("tag_name"), "sha")


def resolved(repositories: DataFrame, refs: DataFrame, key: str, release: str, branch: str) -> DataFrame:
    """repositories with target_ref, target_type and commit_sha: the release tag if there is a ref of that name, else the
    default branch. A name is looked up as it is, then as a tag, then as a branch; '' where nothing is found."""
    short = refs.select(F.col(key).alias("__k"), ref_name(F.col("ref")).alias("__n"), "sha", F.when(F.col("ref").startswith("refs/tags/"), 1).when(F.col("ref").startswith("refs/heads/"), 2).otherwise(0).alias("o"))
    named = short.groupBy("__k", "__n").agg(F.min_by("sha", "o").alias("sha"))
    first, second = named.select(F.col("__k").alias("k1"), F.col("__n").alias("n1"), F.col("sha").alias("s1")), named.select(F.col("__k").alias("k2"), F.col("__n").alias("n2"), F.col("sha").alias("s2"))
    joined = repositories.join(first, (F.col(key) == F.col("k1")) & (F.nullif(release, F.lit("")) == F.col("n1")), "left").join(second, (F.col(key) == F.col("k2")) & (F.nullif(branch, F.lit("")) == F.col("n2")), "left")
    return joined.select(
        *repositories.columns,
        F.when(F.col("s1").isNotNull(), F.col(release)).otherwise(filled(F.col(branch))).alias("target_ref"),
        F.when(F.col("s1").isNotNull(), "release").otherwise("branch").alias("target_type"),
        F.coalesce("s1", "s2", F.lit("")).alias("commit_sha"),
    )


def manifest_urls(repositories: DataFrame, manifests: DataFrame, base: str = "https://raw.githubusercontent.com/") -> DataFrame:
    """id, manifest, url: every manifest name of a repository's language, at its tag if its ref is a release, else at
    its commit. A join on the language with a constant dimension, not a product."""
    version = F.when(F.col("sbom_ref_type") == "release", F.col("sbom_ref")).otherwise(F.col("sbom_commit_sha"))
    rows = repositories.withColumn("__l", F.lower("language")).join(manifests.withColumnRenamed("language", "__l"), "__l")
    return rows.select("id", "manifest", F.concat_ws("/", F.concat(F.lit(base), "owner"), "repo", version, "manifest").alias("url"))


def content_hash(files: DataFrame, group: list[str], path: str, content: str) -> DataFrame:
    """group, hash: SHA-256 over the files in order of their paths, each as its path and content. A group is one
    repository's manifests, a list bounded by the manifest names of a language."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.coalesce(content, F.lit("")).alias("c"))))
    return files.groupBy(*group).agg(pieces.alias("all")).select(*group, F.sha2(F.array_join(F.transform("all", lambda x: F.concat(x["p"], x["c"])), ""), 256).alias("hash"))
