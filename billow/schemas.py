"""Schemas of the tables and files. Field names are those of the formats that are read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


ATOMS = {"bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "double": T.DoubleType()}


def split_top(text: str) -> list[str]:
    """The parts of a text at commas outside angle brackets."""
    parts, level, start = [], 0, 0
    for i, c in enumerate(text):
        level += (c == "<") - (c == ">")
        if c == "," and not level:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]]]


def kind_of(text: str) -> T.DataType:
    if "<" not in text:
        return ATOMS[text]
    outer, inner = text[:-1].split("<", 1)
    if outer == "array":
        return T.ArrayType(kind_of(inner))
    if outer == "map":
        return T.MapType(*map(kind_of, split_top(inner)))
    return T.StructType([T.StructField(name, kind_of(kind.strip())) for name, kind in (p.split(":", 1) for p in split_top(inner))])


def struct(text: str) -> T.StructType:
    """A schema from 'name type, ...', without a session."""
    return T.StructType([T.StructField(name, kind_of(kind.strip())) for name, kind in (p.split(" ", 1) for p in split_top(text))])


REPOSITORIES = struct(
    "id bigint, owner string, repo string, url string, stars bigint, description string, created_at timestamp, language string, topics array<string>, "
    "default_branch string, sbom_ref string, sbom_ref_type string, sbom_commit_sha string, sbom_commit_sha_short string, has_releases boolean, "
    "latest_release_tag string, latest_release_published_at timestamp, total_releases bigint, updated_at timestamp, pushed_at timestamp, is_archived boolean, "
    "is_fork boolean, is_template boolean, is_mirror boolean, disk_usage bigint, fork_count bigint, watchers_count bigint, license_spdx_id string, "
    "license_name string, languages string, vulnerability_alerts_count bigint"
)
ARTIFACTS = struct(
    "repository_id bigint, artifact_id string, name string, version string, type string, purl string, found_by string, licenses array<string>, "
    "sbom_ref string, sbom_commit_sha string, updated_at timestamp"
)
RELEASES = struct(
    "repository_id bigint, release_id bigint, tag_name string, name string, is_prerelease boolean, is_draft boolean, published_at timestamp, "
    "target_commitish string, created_at timestamp, release_assets string, source string, updated_at timestamp"
)
TABLES = {"repositories": REPOSITORIES, "artifacts": ARTIFACTS, "releases": RELEASES}

RELEASE = (
    "id: bigint, tag_name: string, name: string, published_at: string, target_commitish: string, is_prerelease: boolean, prerelease: boolean, "
    "is_draft: boolean, draft: boolean, created_at: string, assets: array<map<string,string>>, source: string"
)
#: A line of a ledger. owner and license may be text or objects, so they are read as text.
LEDGER = struct(
    "id bigint, owner string, repo string, name string, stars bigint, stargazers_count bigint, url string, html_url string, created_at string, "
    "updated_at string, pushed_at string, default_branch string, description string, topics array<string>, language string, license string, "
    "license_spdx_id string, license_name string, is_archived boolean, archived boolean, is_fork boolean, fork boolean, is_template boolean, "
    "is_mirror boolean, disk_usage bigint, size bigint, fork_count bigint, forks_count bigint, watchers_count bigint, has_releases boolean, "
    f"total_releases bigint, latest_stable_release struct<{RELEASE}>, all_releases array<struct<{RELEASE}>>, "
    "download_target struct<ref: string, ref_type: string, commit_sha: string, commit_sha_short: string>, local_content_path string, sbom_path string"
)
SBOM = struct("artifacts array<struct<id: string, name: string, version: string, type: string, purl: string, foundBy: string, licenses: string>>")
RELEASE_CACHE = struct("releases array<string>, tags map<string,string>, updated_at timestamp")
RELEASE_PAGE = struct("tag_name string, name string, prerelease boolean, draft boolean, published_at string, created_at string, target_commitish string")
ENDPOINTS = struct("method string, path string")

CANDIDATES = [
    "language", "framework", "framework_version", "owner", "repo", "stars", "default_branch", "latest_release", "commit_sha", "url", "openapi_file",
    "openapi_url", "matched_dependencies", "has_openapi_file", "has_openapi_deps", "generation_command",
]
PROJECTS = ["language", "framework", "owner", "repo", "stars", "default_branch", "latest_release", "commit_sha", "url"]
DRIFT = [
    "language", "framework", "owner", "repo", "stars", "tag", "implemented_endpoints", "documented_endpoints", "precision", "recall", "f1_score",
    "openapi_file",
]
PATHS = ["language", "framework", "owner", "repo", "stars", "tag", "method", "path"]
STATS = ["owner", "repo", "framework", "language", "lines", "tokens", "stars", "extensions"]

#: What stands for a missing date, fixed.
NO_DATE = "1970-01-02 00:00:00"


def default_of(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(value, F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(kind, T.LongType):
        return F.coalesce(value, F.lit(0).cast("bigint"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(value, F.array().cast(kind))
    if isinstance(kind, T.TimestampType):
        return F.coalesce(value, F.lit(NO_DATE).cast("timestamp"))
    return value


def normalised(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """The columns of a warehouse table without nulls: '', 0, false, empty lists and NO_DATE stand in.

    vulnerability_alerts_count may be null; updated_at stays as it is, being the version; a null id or repository_id
    stays null and so matches nothing in a join.
    """
    schema = TABLES[table]
    keep = {"vulnerability_alerts_count", "updated_at", "id", "repository_id"}
    return df.select([(F.col(c) if c in keep else default_of(schema[c].dataType, F.col(c))).alias(c) for c in (columns or schema.names)])
