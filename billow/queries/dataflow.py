"""Queries of the collection and analysis stages on the test tables.

File trees, API descriptions and endpoint sets have no table of their own: `tree`, `specs` and `endpoints` derive them
from documents and events, the same way in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billow.dims import CATEGORIES, LANGUAGES, manifests
from billow.functions.scalars import lines_of_code
from billow.operators import sets
from billow.operators.rank import keep_first, latest_value, merged, top_per_group, unseen
from billow.plans import classify, collect, openapi
from billow.plans.export import projects
from billow.functions.tokens import bpe_count
from billow.queries.warehouse import CANDIDATES, DIRECTORIES, FINAL, HIDDEN, NAMED, PROJECTS, TREE_PATH, pick, trees, warehouse
from billow.sources.files import yaml_to_json
from billow.tables import load

SOURCES = ["main.go", "App.PY", "index.ts", "logo.png", "Main.java", "lib.rs", "README.md", "user.rb", "page.php", "view.jsx", "build", ".py", "a.b.kt", "go.sum", "c.mjs"]
MERGED = ["stars", "description", "language", "license_name", "latest_release_tag"]


SOURCE_PATH = f"concat({pick(DIRECTORIES, 'doc_id')}, {pick(SOURCES, 'doc_id')})"
SPEC = """concat('{"paths": {"/Items/{id}/', doc_id % 7, '/": {"get": {}, "POST": {}, "x-note": 1}, "users/:uid?x=', doc_id, '": {"delete": {}}}}')"""


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """repository_id, doc_id, path, text, length: one file a document of a repository."""
    rows = load(spark, folder, "documents").filter("repository_id IS NOT NULL")
    return rows.select("repository_id", "doc_id", F.expr(TREE_PATH).alias("path"), "text", F.coalesce("n_chars", F.lit(0)).alias("length"))


def specs(spark: SparkSession, folder: str) -> DataFrame:
    return tree(spark, folder).select("repository_id", "doc_id", F.expr(SPEC).alias("content"))


def endpoints(spark: SparkSession, folder: str, odd: bool) -> DataFrame:
    rows = load(spark, folder, "events").filter(F.col("event_id") % 2 == int(odd))
    return rows.select("user_id", F.col("event_type").alias("method"), F.concat(F.lit("/v/"), F.floor("value").cast("string")).alias("path"))


def ledger_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "repositories").select("owner", "repo", "id", "stars", "updated_at", "license_name")
    return keep_first(rows, ["owner", "repo"], [F.asc_nulls_last("updated_at"), F.asc("id"), F.asc("stars"), F.asc("license_name")]).select("owner", "repo", "id", "stars")


def incremental_new_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = load(spark, folder, "artifacts").select("repository_id").dropna().distinct()
    return unseen(ids, load(spark, folder, "repositories").select(F.col("id").alias("repository_id")), "repository_id")


def metadata_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "repositories").select("id", "owner", "repo", *MERGED, "updated_at")
    ties = [F.asc(c) for c in MERGED]
    old, new = (keep_first(rows, ["id"], [order, *ties]) for order in (F.asc_nulls_last("updated_at"), F.desc_nulls_last("updated_at")))
    return merged(old, new, "id", MERGED).drop("updated_at")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = warehouse(spark, folder).final("releases", "repository_id", "tag_name", "name", "is_prerelease", "is_draft", "published_at", "created_at", "target_commitish", "source")
    return rows


def release_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = entries(spark, folder)
    tags = load(spark, folder, "releases").select("repository_id", F.coalesce("tag_name", F.lit("")).alias("tag_name")).distinct().select("repository_id", "tag_name", F.md5(F.col("tag_name").cast("binary")).alias("sha"), F.lit(None).cast("timestamp").alias("date"))
    return collect.merged_releases(rows.filter("source = 'github_release'").drop("source"), tags)


def latest_stable(spark: SparkSession, folder: str) -> DataFrame:
    return collect.latest_stable(entries(spark, folder)).select("repository_id", "tag_name", "published_at")


def release_summary(spark: SparkSession, folder: str) -> DataFrame:
    return collect.release_summary(entries(spark, folder))


def ref_resolution(spark: SparkSession, folder: str) -> DataFrame:
    tags = load(spark, folder, "releases").select("repository_id", F.coalesce("tag_name", F.lit("")).alias("tag_name")).distinct().select(F.col("repository_id").alias("id"), F.concat(F.md5(F.col("tag_name").cast("binary")), F.lit("\trefs/tags/"), "tag_name").alias("value"))
    heads = load(spark, folder, "repositories").select("id").distinct().select("id", F.concat(F.md5(F.col("id").cast("string").cast("binary")), F.lit("\trefs/heads/main")).alias("value"))
    refs = collect.refs_of_lines(tags.unionByName(heads), ["id"])
    rows = warehouse(spark, folder).final("repositories", "id", "latest_release_tag", "default_branch")
    return collect.resolved(rows, refs, "id", "latest_release_tag", "default_branch")


def manifest_cross(spark: SparkSession, folder: str) -> DataFrame:
    return collect.manifest_urls(warehouse(spark, folder).final("repositories", "id", "owner", "repo", "language", "sbom_ref", "sbom_ref_type", "sbom_commit_sha"), manifests(spark))


def topn_per_framework(spark: SparkSession, folder: str) -> DataFrame:
    return top_per_group(projects(warehouse(spark, folder), web_only=True), ["framework"], [F.desc("stars"), F.asc("owner"), F.asc("repo")], 3, "rank").select("framework", "rank", "owner", "repo", "stars")


def openapi_file_filter(spark: SparkSession, folder: str) -> DataFrame:
    return openapi.description_files(tree(spark, folder)).select("repository_id", "doc_id", "path")


def best_openapi_file(spark: SparkSession, folder: str) -> DataFrame:
    return openapi.best_file(openapi.description_files(tree(spark, folder)), ["repository_id"], "path", "doc_id")


def best_spec_by_size(spark: SparkSession, folder: str) -> DataFrame:
    return openapi.best_spec(openapi.description_files(tree(spark, folder)), ["repository_id"], "path", "length", "doc_id")


def spec_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    return openapi.spec_endpoints(specs(spark, folder), ["repository_id"])


def yaml_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """The same descriptions, every second one in YAML."""
    text = """concat('paths:\\n  /Items/{id}/', doc_id % 7, '/:\\n    get: {}\\n    POST: {}\\n    x-note: 1\\n  users/:uid?x=', doc_id, ':\\n    delete: {}\\n')"""
    rows = tree(spark, folder).select("repository_id", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.expr(SPEC)).otherwise(F.expr(text)).alias("content"))
    return openapi.spec_endpoints(yaml_to_json(rows, ["repository_id", "doc_id"]), ["repository_id"])


def list_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = openapi.spec_endpoints(specs(spark, folder), ["repository_id", "doc_id"])
    house = warehouse(spark, folder).final("repositories", "id", "language", "owner", "repo", "stars", "latest_release_tag")
    rows = found.join(house, F.col("repository_id") == F.col("id")).select("language", F.lit("").alias("framework"), "owner", "repo", "stars", F.col("latest_release_tag").alias("tag"), "method", "path", F.col("doc_id").alias("position"))
    return openapi.list_paths(rows)


def clone_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Of each framework's candidates the three with most stars that are not there yet; every second version is."""
    found = openapi.candidates(warehouse(spark, folder), trees(spark, folder))
    present = openapi.selected(found).filter("length(repo) % 2 = 0")
    return openapi.selected(found, 3, present).select("framework", "owner", "repo", "version")


def endpoint_union(spark: SparkSession, folder: str) -> DataFrame:
    return sets.either(endpoints(spark, folder, True), endpoints(spark, folder, False))


def endpoint_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return sets.both(endpoints(spark, folder, True), endpoints(spark, folder, False))


def endpoint_missing(spark: SparkSession, folder: str) -> DataFrame:
    return sets.missing(endpoints(spark, folder, True), endpoints(spark, folder, False))


def drift_metrics(spark: SparkSession, folder: str) -> DataFrame:
    keyed = [endpoints(spark, folder, odd).select(F.lit("o").alias("owner"), F.col("user_id").cast("string").alias("repo"), F.lit("t").alias("tag"), "method", "path") for odd in (True, False)]
    rows = load(spark, folder, "customer").select(F.lit("go").alias("language"), F.lit("").alias("framework"), F.lit("o").alias("owner"), F.col("c_custkey").cast("string").alias("repo"), F.col("c_custkey").alias("stars"), F.lit("t").alias("tag"), F.lit("").alias("openapi_file"))
    return openapi.drift(rows, keyed[0], keyed[1])


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """repository_id, language, path, text: one file a document of a known repository, with names of many languages."""
    rows = load(spark, folder, "documents").select("repository_id", F.expr(SOURCE_PATH).alias("path"), "text")
    return rows.join(warehouse(spark, folder).final("repositories", "id", "language"), F.col("repository_id") == F.col("id")).drop("id")


def repo_token_stats(spark: SparkSession, folder: str) -> DataFrame:
    return openapi.source_stats(sources(spark, folder), ["repository_id", "language"])


def repo_bpe_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and tokens of each repository's sources, tokens by a public vocabulary: SQL has no such count."""
    return openapi.source_stats(sources(spark, folder), ["repository_id", "language"], tokens=lambda text: bpe_count(spark, text))


def context_fit(spark: SparkSession, folder: str) -> DataFrame:
    windows = spark.createDataFrame([("small", 200), ("middle", 2000)], "model string, tokens bigint")
    return openapi.context_fit(repo_token_stats(spark, folder).select("repository_id", "tokens"), windows, ["small", "middle"])


def tree_size_saved(spark: SparkSession, folder: str) -> DataFrame:
    return openapi.tree_sizes(tree(spark, folder), ["repository_id"])


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "documents")
    files = rows.select("doc_id", F.lit("b").alias("path"), F.col("text").alias("content")).unionByName(rows.select("doc_id", F.lit("a").alias("path"), F.col("path").alias("content")))
    return collect.content_hash(files, ["doc_id"], "path", "content")


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", lines_of_code(F.col("text")).alias("lines"))


def distinct_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return openapi.distinct_projects(openapi.candidates(warehouse(spark, folder), trees(spark, folder)))


def last_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of the last row of each owner, by time, then id."""
    rows = load(spark, folder, "repositories").select("owner", "id", F.coalesce("language", F.lit("")).alias("language"), "updated_at")
    return latest_value(rows, ["owner"], "language", [F.col("updated_at"), F.col("id"), F.col("language")], "language")


def classification_flat(spark: SparkSession, folder: str) -> DataFrame:
    rows = warehouse(spark, folder).final("repositories", "id", "owner", "repo", "stars", "language", "topics", "description", "default_branch", "latest_release_tag", "pushed_at")
    kinds = F.element_at(F.array(*map(F.lit, [*CATEGORIES, "Web Library"])), (F.col("id") % 9 + 1).cast("int"))
    said = rows.select("id", "owner", "repo", "stars", "language", "topics", "description", "default_branch", F.col("latest_release_tag").alias("latest_release"), kinds.alias("category"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.lit("zh").alias("description_zh"), F.lit(None).cast("string").alias("description_en"), F.lit("r").alias("reasoning"), F.col("pushed_at").alias("analyzed_at"))
    found = warehouse(spark, folder).repository_frameworks().withColumn("priority", F.lit(0))
    return classify.flat(said, found)


def release_steps(spark: SparkSession, folder: str) -> DataFrame:
    rows = warehouse(spark, folder).final("releases", "repository_id", "tag_name", "published_at")
    return openapi.plotted(rows.groupBy("repository_id", "published_at").agg(F.count("*").alias("n")), ["repository_id"], "published_at", 3)


QUERIES = {
    f.__name__: f
    for f in (
        ledger_keep_first, incremental_new_ids, metadata_merge, release_merge, latest_stable, release_summary, ref_resolution, manifest_cross, topn_per_framework,
        openapi_file_filter, best_openapi_file, best_spec_by_size, spec_endpoints, yaml_endpoints, list_paths, clone_selection, endpoint_union, endpoint_intersect, endpoint_missing,
        drift_metrics, repo_token_stats, repo_bpe_tokens, context_fit, tree_size_saved, content_hash, document_lines,
        distinct_candidates, last_language, classification_flat, release_steps,
    )
}

TREE = f"t AS (SELECT repository_id, doc_id, {TREE_PATH} AS path, text, coalesce(n_chars, 0) AS length FROM documents WHERE repository_id IS NOT NULL)"
SPECS = f"""x AS (SELECT DISTINCT repository_id, doc_id, m AS method, p AS path FROM (SELECT repository_id, doc_id, unnest(['GET', 'POST', 'DELETE']) AS m,
  unnest(['/items/{{}}/' || (doc_id % 7), '/items/{{}}/' || (doc_id % 7), '/users/{{}}']) AS p FROM documents WHERE repository_id IS NOT NULL))"""
DESCRIBED = f"f AS (SELECT * FROM t WHERE {NAMED} AND NOT ({HIDDEN}))"
EVENTS = "e AS (SELECT user_id, event_type AS method, '/v/' || CAST(floor(value) AS BIGINT) AS path, event_id % 2 = 1 AS odd FROM events)"
TAGS = "tags AS (SELECT DISTINCT repository_id, coalesce(tag_name, '') AS tag_name FROM releases)"
FILLED = [f"coalesce(n.{c}, o.{c}) AS {c}" for c in MERGED]
MANIFESTS = "(VALUES " + ", ".join(f"('{language}', '{name}')" for language, name in [(a, b) for a, spec in LANGUAGES.items() for b in spec[0]]) + ") AS m(l, manifest)"
#: Which endings count for which language, and for a language that is not known. Fixed.
ENDS = """(VALUES ('go', ['.go']), ('python', ['.py']), ('java', ['.java', '.kt', '.scala']), ('rust', ['.rs']), ('ruby', ['.rb']), ('php', ['.php']),
   ('node', ['.js', '.ts', '.jsx', '.tsx', '.mjs', '.cjs']), ('javascript', ['.js', '.ts', '.jsx', '.tsx', '.mjs', '.cjs']), ('typescript', ['.js', '.ts', '.jsx', '.tsx', '.mjs', '.cjs'])) AS e(l, ends)"""
STATS = f""", f AS (SELECT d.repository_id, r.language, {SOURCE_PATH} AS path, text FROM (SELECT doc_id, repository_id, text FROM documents) d JOIN r ON d.repository_id = r.id),
   g AS (SELECT f.*, strlen(coalesce(text, '')) <= 1048576 AS small, regexp_replace(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g') AS u
     FROM f LEFT JOIN {ENDS} ON l = lower(language) WHERE NOT (path LIKE 'tests/%')
     AND list_contains(coalesce(ends, ['.py', '.go', '.java', '.rs', '.rb', '.js', '.ts', '.php']), regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1))),
   stats AS (SELECT repository_id, language,
   CAST(sum(CASE WHEN small THEN len(regexp_replace(u, '[^\\n]', '', 'g')) + CASE WHEN u <> '' AND NOT ends_with(u, chr(10)) THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS lines,
   CAST(sum(CASE WHEN small THEN len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{{1,7}}|[0-9]{{1,3}}|[^\\s\\x0BA-Za-z0-9]|[\\s\\x0B]*[\\r\\n]+')) ELSE 0 END) AS BIGINT) AS tokens, count(*) AS files
   FROM g GROUP BY repository_id, language)"""
STABLE = "NOT is_prerelease AND NOT is_draft"
ORDER = "coalesce(published_at, created_at) DESC NULLS LAST, tag_name"
KIND = "list_extract([" + ", ".join(f"'{c}'" for c in [*CATEGORIES, "Other"]) + "], CAST(id % 9 + 1 AS INT))"
SQL = {
    "distinct_candidates": FINAL + CANDIDATES + "SELECT count(DISTINCT (owner, repo)) AS projects FROM found",
    "last_language": "SELECT owner, coalesce(language, '') AS language FROM repositories QUALIFY row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC NULLS LAST, id DESC, coalesce(repositories.language, '') DESC) = 1",
    "classification_flat": FINAL + f""", w AS (SELECT repository_id, framework, version FROM a JOIN p ON name = package_name WHERE usage = 'core' AND name <> ''
        QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY framework, version) = 1)
        SELECT id, owner, repo, {KIND} AS category, {KIND} = 'Web Application' AS is_web_application, {KIND} = 'Web Framework' AS is_web_framework, CASE WHEN {KIND} = 'Web Framework' THEN repo ELSE coalesce(framework, '') END AS framework,
        coalesce(version, '') AS framework_version, stars, 'zh' AS description_zh, '' AS description_en, language, coalesce(array_to_string([x FOR x IN topics IF x IS NOT NULL], ', '), '') AS topics,
        CASE WHEN {KIND} = 'Web Application' THEN 'a, b' ELSE '' END AS tags, description, default_branch, latest_release_tag AS latest_release, 'r' AS reasoning, pushed_at AS analyzed_at FROM r LEFT JOIN w ON w.repository_id = r.id""",
    "release_steps": FINAL + """, d AS (SELECT repository_id, published_at, count(*) AS n FROM l GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY published_at) AS step FROM d QUALIFY count(*) OVER (PARTITION BY repository_id) >= 3""",
    "ledger_keep_first": "SELECT owner, repo, id, stars FROM repositories QUALIFY row_number() OVER (PARTITION BY owner, repo ORDER BY updated_at ASC NULLS LAST, id NULLS FIRST, stars NULLS FIRST, license_name NULLS FIRST) = 1",
    "incremental_new_ids": "SELECT DISTINCT repository_id FROM artifacts WHERE repository_id IS NOT NULL AND repository_id NOT IN (SELECT id FROM repositories WHERE id IS NOT NULL)",
    "metadata_merge": f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at NULLS LAST, {", ".join(c + " NULLS FIRST" for c in MERGED)}) AS first,
        row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, {", ".join(c + " NULLS FIRST" for c in MERGED)}) AS last FROM repositories)
        SELECT o.id, o.owner, o.repo, {", ".join(FILLED)} FROM (SELECT * FROM k WHERE first = 1) o LEFT JOIN (SELECT * FROM k WHERE last = 1) n ON o.id = n.id""",
    "release_merge": FINAL + f""", {TAGS}, g AS (SELECT * FROM l WHERE source = 'github_release')
        SELECT repository_id, tag_name, name, is_prerelease, is_draft, published_at, created_at, target_commitish, source FROM g
        UNION ALL SELECT repository_id, tag_name, tag_name, false, false, NULL, NULL, md5(tag_name), 'git_tag' FROM tags WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.repository_id = tags.repository_id AND g.tag_name = tags.tag_name)""",
    "latest_stable": FINAL + f"SELECT repository_id, tag_name, published_at FROM l WHERE {STABLE} QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY {ORDER}) = 1",
    "release_summary": FINAL + f""", s AS (SELECT repository_id, tag_name, coalesce(published_at, created_at) AS at FROM l WHERE {STABLE} QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY {ORDER}) = 1)
        SELECT c.repository_id, c.n AS total_releases, c.n > 0 AS has_releases, coalesce(s.tag_name, '') AS latest_tag, s.at AS latest_published
        FROM (SELECT repository_id, count(*) AS n FROM l GROUP BY repository_id) c LEFT JOIN s ON s.repository_id IS NOT DISTINCT FROM c.repository_id""",
    "ref_resolution": FINAL + f""", {TAGS} SELECT r.id, r.latest_release_tag, r.default_branch, CASE WHEN t.tag_name IS NOT NULL THEN r.latest_release_tag ELSE r.default_branch END AS target_ref,
        CASE WHEN t.tag_name IS NOT NULL THEN 'release' ELSE 'branch' END AS target_type, coalesce(md5(t.tag_name), md5(u.tag_name), CASE WHEN r.default_branch = 'main' THEN md5(CAST(r.id AS VARCHAR)) END, '') AS commit_sha
        FROM r LEFT JOIN tags t ON t.repository_id = r.id AND t.tag_name = nullif(r.latest_release_tag, '') LEFT JOIN tags u ON u.repository_id = r.id AND u.tag_name = nullif(r.default_branch, '')""",
    "manifest_cross": FINAL + f"SELECT id, manifest, 'https://raw.githubusercontent.com/' || owner || '/' || repo || '/' || CASE WHEN sbom_ref_type = 'release' THEN sbom_ref ELSE sbom_commit_sha END || '/' || manifest AS url FROM r JOIN {MANIFESTS} ON lower(language) = l",
    "topn_per_framework": FINAL + PROJECTS + "SELECT framework, row_number() OVER (PARTITION BY framework ORDER BY stars DESC, owner, repo) AS rank, owner, repo, stars FROM projects WHERE framework <> '' QUALIFY rank <= 3",
    "openapi_file_filter": f"WITH {TREE}, {DESCRIBED} SELECT repository_id, doc_id, path FROM f",
    "best_openapi_file": f"""WITH {TREE}, {DESCRIBED} SELECT repository_id, path FROM f QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY
        CASE WHEN lower(split_part(path, '/', -1)) LIKE '%openapi%' OR lower(split_part(path, '/', -1)) LIKE '%swagger%' THEN 0 ELSE 1 END, length(path) - length(replace(path, '/', '')), length(path), doc_id) = 1""",
    "best_spec_by_size": f"WITH {TREE}, {DESCRIBED} SELECT repository_id, path FROM f QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY CASE WHEN lower(path) LIKE '%.json' THEN 0 ELSE 1 END, length DESC, doc_id) = 1",
    "spec_endpoints": f"WITH {SPECS} SELECT DISTINCT repository_id, method, path FROM x",
    "yaml_endpoints": f"WITH {SPECS} SELECT DISTINCT repository_id, method, path FROM x",
    "list_paths": FINAL + f", {SPECS} SELECT DISTINCT language, '' AS framework, owner, repo, stars, latest_release_tag AS tag, method, path FROM x JOIN r ON x.repository_id = r.id",
    "clone_selection": FINAL + CANDIDATES + """, t AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY framework ORDER BY stars DESC, owner, repo) <= 3),
        u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY owner, repo ORDER BY framework, stars DESC, latest_release, commit_sha) = 1)
        SELECT framework, owner, repo, CASE WHEN latest_release = '' THEN 'HEAD' ELSE trim(latest_release) END || '/' || CASE WHEN commit_sha = '' THEN 'HEAD' ELSE trim(commit_sha) END AS version FROM u WHERE length(repo) % 2 = 1""",
    "endpoint_union": f"WITH {EVENTS} SELECT DISTINCT user_id, method, path FROM e",
    "endpoint_intersect": f"WITH {EVENTS} SELECT user_id, method, path FROM e WHERE odd INTERSECT SELECT user_id, method, path FROM e WHERE NOT odd",
    "endpoint_missing": f"WITH {EVENTS} SELECT user_id, method, path FROM e WHERE odd EXCEPT SELECT user_id, method, path FROM e WHERE NOT odd",
    "drift_metrics": f"""WITH {EVENTS}, u AS (SELECT DISTINCT user_id, lower(path) AS path, upper(method) AS method, odd FROM e),
        n AS (SELECT user_id, count(*) FILTER (odd) AS t, count(*) FILTER (NOT odd) AS f FROM u GROUP BY user_id),
        b AS (SELECT a.user_id, count(*) AS k FROM u a JOIN u b ON a.user_id = b.user_id AND a.path = b.path AND a.method = b.method AND a.odd AND NOT b.odd GROUP BY a.user_id)
        SELECT 'go' AS language, '' AS framework, 'o' AS owner, CAST(c_custkey AS VARCHAR) AS repo, c_custkey AS stars, 't' AS tag, coalesce(t, 0) AS implemented_endpoints, coalesce(f, 0) AS documented_endpoints,
        round(CASE WHEN coalesce(f, 0) = 0 THEN 0.0 ELSE coalesce(k, 0)::DOUBLE / f END, 4) AS precision, round(CASE WHEN coalesce(t, 0) = 0 THEN 0.0 ELSE coalesce(k, 0)::DOUBLE / t END, 4) AS recall,
        round(CASE WHEN coalesce(t + f, 0) = 0 THEN 0.0 ELSE 2 * coalesce(k, 0)::DOUBLE / (t + f) END, 4) AS f1_score, '' AS openapi_file
        FROM customer LEFT JOIN n ON n.user_id = c_custkey LEFT JOIN b ON b.user_id = c_custkey""",
    "repo_token_stats": FINAL + STATS + " SELECT * FROM stats",
    "context_fit": FINAL + STATS + " SELECT repository_id, tokens, tokens <= 200 AS small, tokens <= 2000 AS middle FROM stats",
    "tree_size_saved": f"""WITH {TREE}, s AS (SELECT repository_id, CAST(sum(length) AS BIGINT) AS total, CAST(coalesce(sum(length) FILTER (path NOT LIKE 'tests/%' AND path NOT LIKE '%.png'), 0) AS BIGINT) AS kept FROM t GROUP BY repository_id)
        SELECT *, round(CASE WHEN total = 0 THEN 0.0 ELSE (1 - kept::DOUBLE / total) * 100 END, 1) AS saved_percent FROM s""",
    "content_hash": "SELECT doc_id, sha256('a' || coalesce(path, '') || 'b' || coalesce(text, '')) AS hash FROM documents",
    "document_lines": "SELECT doc_id, CAST(len(regexp_replace(u, '[^\\n]', '', 'g')) + CASE WHEN u <> '' AND NOT ends_with(u, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS lines FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g') AS u FROM documents)",
}
