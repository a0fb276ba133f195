"""Scalar functions on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billow.dims import CATEGORIES
from billow.functions import scalars as S
from billow.tables import load


def normalize_path(spark: SparkSession, folder: str) -> DataFrame:
    path = F.expr("concat(coalesce(path, ''), CASE WHEN doc_id % 5 = 0 THEN '/{Id}/:name/<int:x>/' WHEN doc_id % 5 = 1 THEN '?q=1' WHEN doc_id % 5 = 2 THEN '/ ' ELSE '' END)")
    return load(spark, folder, "documents").select("doc_id", S.normalize_path(path).alias("norm"))


def license_normalize(spark: SparkSession, folder: str) -> DataFrame:
    items = F.array(
        F.coalesce("license_spdx_id", F.lit("")), F.to_json(F.struct(F.lit("").alias("value"), F.col("license_name").alias("spdxExpression"))), F.to_json(F.struct(F.col("language").alias("name"))), F.lit("{}"),
    )
    rows = load(spark, folder, "repositories").select("id", "license_spdx_id", "license_name", "language").distinct()
    return rows.select("id", F.array_join(S.license_names(items), ";").alias("names")).distinct()


def owner_extract(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.col("owner").alias("login"), "id"))).otherwise(F.col("owner"))
    return load(spark, folder, "repositories").select("id", S.owner_name(raw).alias("owner")).distinct()


def iso_parse(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.lit("never")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    at = S.iso_time(text)
    return load(spark, folder, "events").select("event_id", at.alias("at"), S.day(S.time_or_default(at)).alias("day"))


def middle_day(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "repositories").select("id", "updated_at", S.day(S.middle(F.col("created_at"), F.col("updated_at"))).alias("middle")).distinct()


def url_builder(spark: SparkSession, folder: str) -> DataFrame:
    url, tag, sha = F.col("url"), F.col("latest_release_tag"), F.col("sbom_commit_sha")
    return load(spark, folder, "repositories").select("id", S.tree_url(url, tag, sha).alias("tree"), S.blob_url(url, S.ref_of(sha, F.col("default_branch")), F.lit("openapi.yaml")).alias("blob")).distinct()


def ref_fallback(spark: SparkSession, folder: str) -> DataFrame:
    tag, sha, branch = F.col("latest_release_tag"), F.col("sbom_commit_sha"), F.col("default_branch")
    return load(spark, folder, "repositories").select("id", S.ref_of(tag, branch).alias("ref"), S.tag_of(tag, sha, branch).alias("tag"), S.version_path(tag, sha).alias("version")).distinct()


def short_sha(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "artifacts").select("sbom_commit_sha", S.short_sha(F.col("sbom_commit_sha")).alias("short")).distinct()


def ref_names(spark: SparkSession, folder: str) -> DataFrame:
    full = F.concat(F.when(F.col("source") == "git_tag", "refs/tags/").otherwise("refs/heads/"), "tag_name", F.when(F.col("is_prerelease"), "^{}").otherwise(""))
    return load(spark, folder, "releases").select("repository_id", full.alias("full"), S.ref_name(full).alias("name")).distinct()


def natural_size(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", S.natural_size(F.coalesce("n_chars", F.lit(0))).alias("size"))


def assets_json(spark: SparkSession, folder: str) -> DataFrame:
    assets = F.from_json("release_assets", "array<map<string,string>>")
    return load(spark, folder, "releases").select("repository_id", "tag_name", F.coalesce(F.size(assets), F.lit(0)).cast("bigint").alias("assets"), F.to_json(assets).alias("json")).distinct()


def category() -> F.Column:
    return F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("id") % len(CATEGORIES) + 1).cast("int"))


def tag_rule(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.filter(F.coalesce("topics", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return load(spark, folder, "repositories").select("id", "updated_at", F.array_join(S.first_tags(category(), tags), ";").alias("tags")).distinct()


def framework_override(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "repositories").select("id", S.own_framework(category(), F.col("repo"), F.coalesce("language", F.lit(""))).alias("framework")).distinct()


def snippet(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", F.md5(S.snippet(F.col("text")).cast("binary")).alias("digest"))


def csv_list_split(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat_ws(" , ", "owner", "repo", "language", F.lit(""))
    return load(spark, folder, "repositories").select("id", F.array_join(S.comma_list(text), ";").alias("parts")).distinct()


def alias_defaults(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "repositories")
    return rows.select("id", "updated_at", F.coalesce("stars", "watchers_count", F.lit(0)).alias("stars"), F.coalesce("language", F.lit("")).alias("language"), S.filled(F.col("default_branch"), F.lit("main")).alias("branch")).distinct()


def labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "repositories")
    return rows.select(
        "id", S.python_bool(F.coalesce("is_fork", F.lit(False))).alias("fork"), S.thousands(F.coalesce("disk_usage", F.lit(0))).alias("disk"), S.title(F.concat(F.lit("release_of_"), "language")).alias("title"),
        S.cache_name(F.concat("owner", F.lit(":"), "repo")).alias("cache"), S.masked(F.col("url"), F.col("owner")).alias("masked"), S.ratio(F.col("stars"), F.col("fork_count")).alias("ratio"),
    ).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        normalize_path, license_normalize, owner_extract, iso_parse, middle_day, url_builder, ref_fallback, short_sha, ref_names, natural_size, assets_json, tag_rule,
        framework_override, snippet, csv_list_split, alias_defaults, labels,
    )
}
REF = "coalesce(nullif({0}, ''), nullif({1}, ''), '')"
CATEGORY = "list_extract([" + ", ".join(f"'{c}'" for c in CATEGORIES) + f"], CAST(id % {len(CATEGORIES)} + 1 AS INT))"
NORM = "split_part({}, '?', 1)"
SQL = {
    "normalize_path": r"""WITH a AS (SELECT doc_id, trim(lower(split_part(coalesce(path, '') || CASE WHEN doc_id % 5 = 0 THEN '/{Id}/:name/<int:x>/' WHEN doc_id % 5 = 1 THEN '?q=1' WHEN doc_id % 5 = 2 THEN '/ ' ELSE '' END, '?', 1))) AS p FROM documents),
        b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(CASE WHEN p <> '/' THEN regexp_replace(p, '/$', '') ELSE p END, '\{[^}]+\}', '{}', 'g'), ':[a-zA-Z0-9_]+', '{}', 'g'), '<[^>]+>', '{}', 'g') AS p FROM a)
        SELECT doc_id, CASE WHEN p LIKE '/%' THEN p ELSE '/' || p END AS norm FROM b""",
    "license_normalize": "SELECT DISTINCT id, array_to_string([x FOR x IN [nullif(license_spdx_id, ''), nullif(license_name, ''), nullif(language, '')] IF x IS NOT NULL], ';') AS names FROM (SELECT id, license_spdx_id, license_name, language FROM repositories)",
    "owner_extract": "SELECT DISTINCT id, coalesce(owner, '') AS owner FROM repositories",
    "iso_parse": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN date_trunc('second', ts) END AS at, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d') ELSE '1970-01-02' END AS day FROM events",
    "middle_day": "SELECT DISTINCT id, updated_at, strftime(CAST(created_at AS DATE) + CAST(floor((CAST(updated_at AS DATE) - CAST(created_at AS DATE)) / 2) AS INT), '%Y-%m-%d') AS middle FROM repositories",
    "url_builder": f"SELECT DISTINCT id, url || CASE WHEN latest_release_tag <> '' THEN '/releases/tag/' || latest_release_tag WHEN sbom_commit_sha <> '' THEN '/tree/' || sbom_commit_sha ELSE '' END AS tree, url || '/blob/' || {REF.format('sbom_commit_sha', 'default_branch')} || '/openapi.yaml' AS blob FROM repositories",
    "ref_fallback": f"""SELECT DISTINCT id, {REF.format('latest_release_tag', 'default_branch')} AS ref, coalesce(nullif(latest_release_tag, ''), nullif(sbom_commit_sha, ''), nullif(default_branch, ''), '') AS tag,
        coalesce(nullif(trim(latest_release_tag), ''), 'HEAD') || '/' || coalesce(nullif(trim(sbom_commit_sha), ''), 'HEAD') AS version FROM repositories""",
    "short_sha": "SELECT DISTINCT sbom_commit_sha, left(sbom_commit_sha, 7) AS short FROM artifacts",
    "ref_names": "SELECT DISTINCT repository_id, CASE WHEN source = 'git_tag' THEN 'refs/tags/' ELSE 'refs/heads/' END || tag_name || CASE WHEN is_prerelease THEN '^{}' ELSE '' END AS full, tag_name AS name FROM releases",
    "natural_size": "SELECT doc_id, CASE WHEN n = 1 THEN '1 Byte' WHEN n < 1000 THEN n || ' Bytes' WHEN n < 1000000 THEN printf('%.1f kB', n / 1000.0::DOUBLE) ELSE printf('%.1f MB', n / 1000000.0::DOUBLE) END AS size FROM (SELECT doc_id, coalesce(n_chars, 0) AS n FROM documents)",
    "assets_json": """SELECT DISTINCT repository_id, tag_name, coalesce(json_array_length(release_assets), 0)::BIGINT AS assets,
        replace(replace(replace(release_assets, '": "', '":"'), '", "', '","'), '}, {', '},{') AS json FROM releases""",
    "tag_rule": f"SELECT DISTINCT id, updated_at, CASE WHEN {CATEGORY} = 'Web Application' THEN coalesce(array_to_string([x FOR x IN coalesce(topics, []) IF x IS NOT NULL][1:5], ';'), '') ELSE '' END AS tags FROM repositories",
    "framework_override": f"SELECT DISTINCT id, CASE WHEN {CATEGORY} = 'Web Framework' THEN repo ELSE coalesce(language, '') END AS framework FROM repositories",
    "snippet": "SELECT doc_id, md5(left(text, 1000)) AS digest FROM documents",
    "csv_list_split": "SELECT DISTINCT id, array_to_string([x FOR x IN [trim(owner), trim(repo), trim(language)] IF x IS NOT NULL AND x <> ''], ';') AS parts FROM repositories",
    "alias_defaults": f"SELECT DISTINCT id, updated_at, coalesce(stars, watchers_count, 0) AS stars, coalesce(language, '') AS language, {REF.format('default_branch', chr(39) + 'main' + chr(39))} AS branch FROM repositories",
    "labels": r"""SELECT DISTINCT id, CASE WHEN is_fork THEN 'True' ELSE 'False' END AS fork, format('{:,}', coalesce(disk_usage, 0)) AS disk,
        'Release Of ' || upper(left(language, 1)) || lower(substr(language, 2)) AS title, owner || '/' || repo AS cache, CASE WHEN coalesce(owner, '') = '' THEN url ELSE replace(url, owner, '*****') END AS masked,
        round(CASE WHEN coalesce(fork_count, 0) = 0 OR stars IS NULL THEN 0.0 ELSE stars::DOUBLE / fork_count END, 4) AS ratio FROM repositories""",
}
