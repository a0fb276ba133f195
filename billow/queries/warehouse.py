"""Warehouse queries on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billow.dims import framework_packages, ranked
from billow.plans.export import projects
from billow.plans.openapi import candidate_stats, candidates
from billow.plans.warehouse import Warehouse, adhoc
from billow.tables import load

#: Arguments of the queries that take some.
PART, LANGUAGE = "parser", "python"
DIRECTORIES = ["", "docs/", "api/v1/", "tests/", "my-test/", "examples_old/", "Spec/"]
FILES = ["openapi.yaml", "swagger.json", "API.YML", "api.json", "README.md", "logo.png", "main.go", "openapi.json"]


def pick(values: list[str], number: str) -> str:
    """SQL for the element of a list by a number; the same text for both engines."""
    return "CASE " + " ".join(f"WHEN {number} % {len(values)} = {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


TREE_PATH = f"concat({pick(DIRECTORIES, 'doc_id')}, {pick(FILES, 'doc_id')})"
REAL_NAME = f"CASE WHEN length(name) % 3 = 0 THEN {pick(['fastapi', 'starlette', 'django', 'flask', 'express', 'laravel/framework', 'symfony/routing'], 'repository_id')} WHEN length(name) % 3 = 1 THEN {pick(['django', 'fastapi', 'flask', 'symfony/http-kernel', 'rails'], 'length(version)')} ELSE name END"


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    packages = ranked(load(spark, folder, "framework_packages"))
    return Warehouse(load(spark, folder, "repositories"), load(spark, folder, "artifacts"), load(spark, folder, "releases"), packages)


def final_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = warehouse(spark, folder).final("artifacts", "repository_id", "artifact_id", "name", "version", "sbom_commit_sha", "type", "purl", "licenses", "updated_at")
    return rows.withColumn("licenses", F.array_join("licenses", ";"))


def final_repositories(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).final("repositories").withColumn("topics", F.array_join("topics", ";"))


def final_releases(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).final("releases")


def db_stats(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).stats()


def language_stats(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).languages()


def top_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).top_dependencies(20)


def dependency_types(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).types()


def search_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).search(PART, 10)


def library_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).candidates(PART)


def library_candidates_lang(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).candidates(PART, LANGUAGE, 10)


def top_library(spark: SparkSession, folder: str) -> DataFrame:
    """name: the library most used, standing for what a user picks."""
    return warehouse(spark, folder).top_dependencies(1).select("name")


def dependent_count(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).dependent_count(top_library(spark, folder))


def dependents(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).dependents(top_library(spark, folder), LANGUAGE)


def core_names(spark: SparkSession, folder: str) -> DataFrame:
    """name: core packages of the language."""
    return warehouse(spark, folder).core_packages().filter(F.col("language") == LANGUAGE).select(F.col("package_name").alias("name"))


def framework_usage(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).framework_usage(LANGUAGE, core_names(spark, folder))


def framework_top_projects(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).top_projects(LANGUAGE, core_names(spark, folder))


def repo_frameworks(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).repository_frameworks()


def framework_stats(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse(spark, folder).framework_stats()


def export_projects(spark: SparkSession, folder: str) -> DataFrame:
    return projects(warehouse(spark, folder))


def export_web_only(spark: SparkSession, folder: str) -> DataFrame:
    return projects(warehouse(spark, folder), web_only=True)


def trees(spark: SparkSession, folder: str) -> DataFrame:
    """File trees of commits: a file for each document of a repository; every fifth lies in the tree of another commit."""
    house = warehouse(spark, folder)
    rows = load(spark, folder, "documents").select("repository_id", F.col("doc_id").alias("position"), F.expr(TREE_PATH).alias("path"))
    ref = F.coalesce(F.nullif("latest_release_tag", F.lit("")), "default_branch")
    sha = F.when(F.col("position") % 5 == 0, "other").otherwise(F.col("sbom_commit_sha"))
    joined = rows.join(house.final("repositories", "id", "language", "owner", "repo", "latest_release_tag", "default_branch", "sbom_commit_sha"), F.col("repository_id") == F.col("id"))
    return joined.select("language", "owner", "repo", ref.alias("ref"), sha.alias("sha"), "path", "position")


def found_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return candidates(warehouse(spark, folder), trees(spark, folder), base="https://code.example/")


def export_by_fixed_order(spark: SparkSession, folder: str) -> DataFrame:
    """Projects with the packages of the fixed dimension, whose frameworks have an order of their own; names of artifacts
    are turned into such packages."""
    artifacts = load(spark, folder, "artifacts").withColumn("name", F.expr(REAL_NAME))
    return projects(Warehouse(load(spark, folder, "repositories"), artifacts, packages=framework_packages(spark)))


def generation_command(spark: SparkSession, folder: str) -> DataFrame:
    """The command of the first dependency that has one; here every second package for descriptions has."""
    packages = load(spark, folder, "framework_packages").filter("usage = 'openapi' AND length(package_name) % 2 = 0")
    commands = packages.select("framework", F.col("package_name").alias("dependency"), F.concat(F.lit("make "), "package_name").alias("command"))
    fallback = load(spark, folder, "framework_packages").select("framework", F.col("framework").alias("dependency"), F.concat(F.lit("run "), "framework").alias("command")).distinct()
    found = candidates(warehouse(spark, folder), commands=commands.unionByName(fallback))
    return found.select("framework", "owner", "repo", "matched_dependencies", "generation_command")


def candidate_stats_total(spark: SparkSession, folder: str) -> DataFrame:
    house = warehouse(spark, folder)
    totals = house.framework_stats().groupBy("framework").agg(F.sum("repositories").alias("total"))
    return candidate_stats(candidates(house, trees(spark, folder)), totals)


def adhoc_sql(spark: SparkSession, folder: str) -> DataFrame:
    warehouse(spark, folder).register(spark)
    text = """SELECT r.language, count(*) AS releases, count(DISTINCT l.repository_id) AS repositories
              FROM releases l JOIN repositories r ON l.repository_id = r.id WHERE l.is_prerelease = :early GROUP BY r.language"""
    return adhoc(spark, text, {"early": False})


S = "coalesce({0}, '') AS {0}"
R_STRINGS = ["owner", "repo", "url", "description", "language", "default_branch", "sbom_ref", "sbom_ref_type", "sbom_commit_sha", "sbom_commit_sha_short", "latest_release_tag", "license_spdx_id", "license_name", "languages"]
R_NUMBERS = ["stars", "total_releases", "disk_usage", "fork_count", "watchers_count"]
R_FLAGS = ["has_releases", "is_archived", "is_fork", "is_template", "is_mirror"]
R_DATES = ["created_at", "latest_release_published_at", "pushed_at"]
DAY = "coalesce({0}, TIMESTAMP '1970-01-02 00:00:00') AS {0}"
FINAL = f"""WITH r AS (SELECT id, {", ".join([S.format(c) for c in R_STRINGS] + [f"coalesce({c}, 0) AS {c}" for c in R_NUMBERS] + [f"coalesce({c}, false) AS {c}" for c in R_FLAGS] + [DAY.format(c) for c in R_DATES])},
   coalesce(topics, []) AS topics, updated_at, vulnerability_alerts_count FROM repositories QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1),
 a AS (SELECT repository_id, {", ".join(S.format(c) for c in ["artifact_id", "name", "version", "type", "purl", "found_by", "sbom_ref", "sbom_commit_sha"])}, coalesce(licenses, []) AS licenses, updated_at FROM artifacts
   QUALIFY row_number() OVER (PARTITION BY repository_id, coalesce(artifacts.artifact_id, ''), coalesce(artifacts.name, ''), coalesce(artifacts.version, ''), coalesce(artifacts.sbom_commit_sha, '') ORDER BY updated_at DESC NULLS LAST) = 1),
 l AS (SELECT repository_id, coalesce(release_id, 0) AS release_id, {", ".join(S.format(c) for c in ["tag_name", "name", "target_commitish", "release_assets", "source"])}, coalesce(is_prerelease, false) AS is_prerelease,
   coalesce(is_draft, false) AS is_draft, {DAY.format("published_at")}, {DAY.format("created_at")}, updated_at FROM releases
   QUALIFY row_number() OVER (PARTITION BY repository_id, coalesce(releases.tag_name, '') ORDER BY updated_at DESC NULLS LAST) = 1),
 p AS (SELECT *, dense_rank() OVER (PARTITION BY language ORDER BY framework) AS priority FROM framework_packages)
"""
TOP = "(SELECT name FROM a GROUP BY name ORDER BY count(DISTINCT repository_id) DESC, name LIMIT 1)"
CORE = f"(SELECT package_name FROM p WHERE usage = 'core' AND language = '{LANGUAGE}')"
USED = """, used AS (SELECT DISTINCT p.language, p.framework, r.id, r.owner, r.repo, r.stars FROM p JOIN a ON a.name = p.package_name JOIN r ON r.id = a.repository_id AND lower(r.language) = p.language WHERE p.usage = 'core'),
 fs AS (SELECT p.language, p.framework, count(DISTINCT u.id) AS repositories,
   coalesce((SELECT string_agg(x, ';' ORDER BY k) FROM (SELECT owner || '/' || repo AS x, row_number() OVER (ORDER BY stars DESC, owner, repo, id) AS k FROM used v WHERE v.language = p.language AND v.framework = p.framework) WHERE k <= 3), '') AS samples
   FROM (SELECT DISTINCT language, framework FROM p WHERE usage = 'core') p LEFT JOIN used u ON u.language = p.language AND u.framework = p.framework GROUP BY p.language, p.framework)
"""
PROJECTS = """, hit AS (SELECT r.id, arg_min(p.framework, p.priority) AS framework FROM r JOIN a ON a.repository_id = r.id JOIN p ON p.package_name = a.name AND p.language = lower(r.language) AND p.usage = 'core' GROUP BY r.id),
 projects AS (SELECT lower(r.language) AS language, coalesce(framework, '') AS framework, owner, repo, stars, default_branch, latest_release_tag AS latest_release, sbom_commit_sha AS commit_sha, url FROM r LEFT JOIN hit ON hit.id = r.id)
"""
HIDDEN = "path LIKE 'tests/%' OR path LIKE 'my-test/%' OR path LIKE 'examples_old/%'"
NAMED = "lower(split_part(path, '/', -1)) IN ('openapi.yaml', 'swagger.json', 'api.yml', 'api.json', 'openapi.json')"
CANDIDATES = f""", tf AS (SELECT doc_id, lower(r.language) AS tl, lower(owner) AS own, lower(repo) AS rep, lower(coalesce(nullif(latest_release_tag, ''), default_branch)) AS ref,
   lower(CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE sbom_commit_sha END) AS sha, {TREE_PATH} AS path FROM (SELECT doc_id, repository_id FROM documents) d JOIN r ON d.repository_id = r.id),
 best AS (SELECT * FROM tf WHERE {NAMED} AND NOT ({HIDDEN}) QUALIFY row_number() OVER (PARTITION BY tl, own, rep, ref, sha ORDER BY
   CASE WHEN lower(split_part(path, '/', -1)) LIKE '%openapi%' OR lower(split_part(path, '/', -1)) LIKE '%swagger%' THEN 0 ELSE 1 END, length(path) - length(replace(path, '/', '')), length(path), doc_id) = 1),
 s AS (SELECT framework, package_name, usage, min(language) AS language FROM p GROUP BY ALL),
 h AS (SELECT a.repository_id, s.framework, max(CASE WHEN usage = 'core' THEN version END) AS v, count(*) FILTER (usage = 'core') AS core, count(*) FILTER (usage = 'excluded') AS excluded,
   coalesce(string_agg(DISTINCT lower(a.name), ';' ORDER BY lower(a.name)) FILTER (usage = 'openapi'), '') AS deps, max(s.language) AS fl FROM a JOIN s ON a.name = s.package_name GROUP BY ALL),
 k AS (SELECT coalesce(nullif(lower(language), ''), fl) AS language, framework, lower(coalesce(v, '')) AS framework_version, lower(owner) AS owner, lower(repo) AS repo, stars, lower(default_branch) AS default_branch,
   lower(latest_release_tag) AS latest_release, lower(sbom_commit_sha) AS commit_sha, deps AS matched_dependencies FROM h JOIN r ON h.repository_id = r.id WHERE core > 0 AND excluded = 0),
 c AS (SELECT k.*, coalesce(path, '') AS openapi_file, coalesce(nullif(commit_sha, ''), nullif(latest_release, ''), default_branch) AS place FROM k LEFT JOIN best ON tl = language AND own = owner AND rep = repo AND sha = commit_sha
   AND ref = coalesce(nullif(latest_release, ''), default_branch) WHERE matched_dependencies <> '' OR path IS NOT NULL),
 found AS (SELECT *, 'https://code.example/' || owner || '/' || repo || CASE WHEN latest_release <> '' THEN '/releases/tag/' || latest_release WHEN commit_sha <> '' THEN '/tree/' || commit_sha ELSE '' END AS url,
   CASE WHEN openapi_file <> '' THEN 'https://code.example/' || owner || '/' || repo || '/blob/' || place || '/' || openapi_file ELSE '' END AS openapi_url, openapi_file <> '' AS has_openapi_file, matched_dependencies <> '' AS has_openapi_deps, '' AS generation_command FROM c)
"""

QUERIES = {
    "final_dedup": final_dedup,
    "final_repositories": final_repositories,
    "final_releases": final_releases,
    "db_stats": db_stats,
    "language_stats": language_stats,
    "top_dependencies": top_dependencies,
    "dependency_types": dependency_types,
    "search_artifacts": search_artifacts,
    "library_candidates": library_candidates,
    "library_candidates_lang": library_candidates_lang,
    "dependent_count": dependent_count,
    "dependents": dependents,
    "framework_usage": framework_usage,
    "framework_top_projects": framework_top_projects,
    "repo_frameworks": repo_frameworks,
    "framework_stats": framework_stats,
    "export_projects": export_projects,
    "export_web_only": export_web_only,
    "candidates": found_candidates,
    "export_by_fixed_order": export_by_fixed_order,
    "generation_command": generation_command,
    "candidate_stats_total": candidate_stats_total,
    "adhoc_sql": adhoc_sql,
}
SQL = {
    "final_dedup": FINAL + "SELECT repository_id, artifact_id, name, version, sbom_commit_sha, type, purl, coalesce(array_to_string(licenses, ';'), '') AS licenses, updated_at FROM a",
    "final_repositories": FINAL + "SELECT * REPLACE (coalesce(array_to_string(topics, ';'), '') AS topics) FROM r",
    "final_releases": FINAL + "SELECT * FROM l",
    "db_stats": FINAL + "SELECT (SELECT count(*) FROM r) AS repositories, (SELECT count(*) FROM a) AS artifacts",
    "language_stats": FINAL + "SELECT language, count(*) AS cnt FROM r GROUP BY language",
    "top_dependencies": FINAL + "SELECT name, count(DISTINCT repository_id) AS repo_count FROM a GROUP BY name ORDER BY repo_count DESC, name LIMIT 20",
    "dependency_types": FINAL + "SELECT type, count(*) AS cnt FROM a GROUP BY type",
    "search_artifacts": FINAL + f"SELECT owner, repo, name, version FROM a JOIN r ON repository_id = id WHERE name ILIKE '%{PART}%' ORDER BY owner, repo, name, version LIMIT 10",
    "library_candidates": FINAL + f"SELECT name, count(*) AS cnt, count(DISTINCT id) AS repo_cnt FROM a JOIN r ON repository_id = id WHERE name ILIKE '%{PART}%' GROUP BY name ORDER BY cnt DESC, name LIMIT 20",
    "library_candidates_lang": FINAL + f"SELECT name, count(*) AS cnt, count(DISTINCT id) AS repo_cnt FROM a JOIN r ON repository_id = id WHERE name ILIKE '%{PART}%' AND language = '{LANGUAGE}' GROUP BY name ORDER BY cnt DESC, name LIMIT 10",
    "dependent_count": FINAL + f"SELECT count(*) AS dependents FROM a JOIN r ON repository_id = id WHERE name = {TOP}",
    "dependents": FINAL + f"SELECT owner, repo, stars, version, url FROM a JOIN r ON repository_id = id WHERE name = {TOP} AND language = '{LANGUAGE}' ORDER BY stars DESC, owner, repo, version, url LIMIT 50",
    "framework_usage": FINAL + f"SELECT count(DISTINCT id) AS repositories FROM a JOIN r ON repository_id = id WHERE lower(language) = '{LANGUAGE}' AND name IN {CORE}",
    "framework_top_projects": FINAL + f"SELECT DISTINCT owner, repo, stars, url FROM a JOIN r ON repository_id = id WHERE lower(language) = '{LANGUAGE}' AND name IN {CORE} ORDER BY stars DESC, owner, repo, url LIMIT 3",
    "repo_frameworks": FINAL + "SELECT DISTINCT repository_id, framework, version FROM a JOIN p ON name = package_name WHERE usage = 'core' AND name <> ''",
    "framework_stats": FINAL + USED + "SELECT * FROM fs",
    "export_projects": FINAL + PROJECTS + "SELECT * FROM projects",
    "export_web_only": FINAL + PROJECTS + "SELECT * FROM projects WHERE framework <> ''",
    "export_by_fixed_order": FINAL.replace("FROM artifacts", f"FROM (SELECT * REPLACE ({REAL_NAME} AS name) FROM artifacts) artifacts")
    + """, f(l, framework, name, k) AS (VALUES ('python', 'flask', 'flask', 0), ('python', 'django', 'django', 1), ('python', 'fastapi', 'fastapi', 2), ('python', 'fastapi', 'starlette', 2), ('ruby', 'rails', 'rails', 0),
        ('php', 'laravel', 'laravel/framework', 0), ('php', 'symfony', 'symfony/routing', 1), ('php', 'symfony', 'symfony/http-kernel', 1), ('javascript', 'express', 'express', 0), ('typescript', 'express', 'express', 0)),
      g AS (SELECT r.id, arg_min(f.framework, k) AS framework FROM r JOIN a ON a.repository_id = r.id JOIN f ON f.name = a.name AND l = lower(r.language) GROUP BY r.id)
      SELECT lower(language) AS language, coalesce(framework, '') AS framework, owner, repo, stars, default_branch, latest_release_tag AS latest_release, sbom_commit_sha AS commit_sha, url FROM r LEFT JOIN g ON g.id = r.id""",
    "candidates": FINAL + CANDIDATES + "SELECT language, framework, framework_version, owner, repo, stars, default_branch, latest_release, commit_sha, url, openapi_file, openapi_url, matched_dependencies, has_openapi_file, has_openapi_deps, generation_command FROM found",
    "generation_command": FINAL + CANDIDATES + """SELECT framework, owner, repo, matched_dependencies,
      coalesce('make ' || list_extract([d FOR d IN string_split(matched_dependencies, ';') IF length(d) % 2 = 0], 1), 'run ' || framework) AS generation_command FROM found WHERE has_openapi_deps""",
    "candidate_stats_total": FINAL + CANDIDATES + USED + """, t AS (SELECT framework, CAST(sum(repositories) AS BIGINT) AS total FROM fs GROUP BY framework), m AS (SELECT framework, count(*) AS n, count(*) FILTER (has_openapi_file AND has_openapi_deps) AS b, count(*) FILTER (NOT has_openapi_deps) AS f, count(*) FILTER (NOT has_openapi_file) AS d FROM found GROUP BY framework),
      z AS (SELECT t.framework, total, coalesce(n, 0) AS matched, coalesce(b, 0) AS b, coalesce(f, 0) AS f, coalesce(d, 0) AS d FROM t LEFT JOIN m ON m.framework = t.framework),
      g AS (SELECT coalesce(framework, 'TOTAL') AS framework, CAST(sum(total) AS BIGINT) AS total, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(b) AS BIGINT) AS b, CAST(sum(f) AS BIGINT) AS f, CAST(sum(d) AS BIGINT) AS d FROM z GROUP BY ROLLUP (framework))
      SELECT framework, total, matched, b AS "both", f AS file_only, d AS deps_only, round(CASE WHEN total = 0 THEN 0.0 ELSE matched::DOUBLE * 100 / total END, 2) AS percentage FROM g""",
    "adhoc_sql": FINAL + "SELECT language, count(*) AS releases, count(DISTINCT l.repository_id) AS repositories FROM l JOIN r ON l.repository_id = r.id WHERE NOT is_prerelease GROUP BY language",
}
