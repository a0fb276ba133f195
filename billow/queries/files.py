"""Readers, writers and streams on files that are made of the test tables.

Each query writes its files into the shared folder of the session (see `billow.session.scratch`), reads them back with
the operator, and must give what the tables hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billow import dims
from billow.functions.scalars import capped
from billow.operators.rank import keep_first
from billow.plans import classify
from billow.queries.dataflow import SQL as DATAFLOW
from billow.queries.dataflow import ENDS, classification_flat
from billow.queries.warehouse import FINAL, TREE_PATH, trees, warehouse
from billow.schemas import TABLES
from billow.session import scratch
from billow.sinks import tables as sinks
from billow.sources import checks, files
from billow.sources.search import SearchSource
from billow.streaming import ledger as streams
from billow.tables import KEYS, load, newest

PAGES, LEAST = 16, 100


def ledger_lines(spark: SparkSession, folder: str) -> DataFrame:
    """value: a line for each row of repositories, in one spelling of the fields or the other, then a blank line and one
    that is no JSON."""
    rows = load(spark, folder, "repositories")
    one = F.to_json(F.struct("id", "owner", "repo", "stars", "url", "is_fork", "language", F.lit(1).alias("unknown")))
    other = F.to_json(F.struct("id", F.struct(F.col("owner").alias("login"), "id").alias("owner"), F.col("repo").alias("name"), F.col("stars").alias("stargazers_count"), F.col("url").alias("html_url"), F.col("is_fork").alias("fork"), "language"))
    return rows.select(F.when(F.col("id") % 2 == 0, one).otherwise(other).alias("value")).unionByName(spark.createDataFrame([("",), ("{broken",)], "value string"))


def written_ledger(spark: SparkSession, folder: str) -> str:
    path = scratch(spark) + "/ledger"
    ledger_lines(spark, folder).write.text(path)
    return path


def ledger_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = files.ledger(files.json_lines(spark, written_ledger(spark, folder)))
    return rows.select("id", "owner", "repo", "stars", "url", F.coalesce("is_fork", F.lit(False)).alias("is_fork"), "default_branch")


def ledger_failures(spark: SparkSession, folder: str) -> DataFrame:
    return files.failed_lines(files.json_lines(spark, written_ledger(spark, folder)))


def ledger_resume(spark: SparkSession, folder: str) -> DataFrame:
    return files.seen_and_least(files.ledger(files.json_lines(spark, written_ledger(spark, folder))))


def ledger_may_stop(spark: SparkSession, folder: str) -> DataFrame:
    """least, stop: may a search stop at this number of stars?"""
    rows = files.ledger(files.json_lines(spark, written_ledger(spark, folder)))
    return spark.createDataFrame([(least, streams.may_stop(rows, least)) for least in (-1, 0, 10**6)], "least bigint, stop boolean")


def ledger_text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the ledger that are not blank, by their length."""
    rows = files.text_lines(spark, written_ledger(spark, folder))
    return rows.agg(F.count("*").alias("lines"), F.count_if(F.col("value").startswith("{")).alias("objects"))


def ledger_append(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of even ids, then all rows, into one ledger: each id is there once."""
    path = scratch(spark) + "/ledger"
    rows = load(spark, folder, "repositories").select("id", "owner", "repo", "updated_at", "stars", "license_name")
    order = [F.asc_nulls_last("updated_at"), F.asc("stars"), F.asc("license_name")]
    for part in (rows.filter("id % 2 = 0"), rows):
        sinks.append_ledger(part, path, "id", order)
    return spark.read.schema("id bigint, owner string, repo string").json(path)


def sbom_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Artifacts of 64 SBOM files as warehouse rows; a file's repository is the number in its name."""
    path = scratch(spark) + "/sboms"
    rows = load(spark, folder, "artifacts").filter("repository_id IS NOT NULL")
    element = F.struct(F.col("artifact_id").alias("id"), "name", "version", "type", "purl", F.col("found_by").alias("foundBy"), "licenses")
    documents = rows.groupBy((F.col("repository_id") % 64).alias("part")).agg(F.to_json(F.struct(F.collect_list(element).alias("artifacts"))).alias("value"))
    documents.repartition("part").write.partitionBy("part").text(path)
    elements = files.sboms(spark, path)
    named = elements.select(F.col("file").alias("sbom_file")).distinct()
    repositories = named.select("sbom_file", F.regexp_extract("sbom_file", r"part=(\d+)", 1).cast("bigint").alias("id"), F.lit("main").alias("sbom_ref"), F.lit("sha").alias("sbom_commit_sha"))
    found = files.artifact_rows(elements, repositories, F.lit("2024-01-01").cast("timestamp"))
    return found.select("repository_id", "artifact_id", "name", "version", "type", "purl", "found_by", F.array_join("licenses", ";").alias("licenses"), "sbom_ref", "sbom_commit_sha")


def csv_texts(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark) + "/csv"
    sinks.write_csv(warehouse(spark, folder).final("repositories", "id", "owner", "stars", "description", "is_fork"), path)
    return files.csv_text(spark, path)


def csv_types(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark) + "/csv"
    rows = load(spark, folder, "releases").select("repository_id", "release_id", "tag_name").distinct()
    sinks.write_csv(rows, path)
    typed = files.csv_typed(spark, path, rows.schema)
    return typed.select("repository_id", "release_id", F.coalesce("tag_name", F.lit("")).alias("tag_name"))


def search_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Saved result pages, read in ranges of stars."""
    path = scratch(spark) + "/pages"
    item = F.struct("id", F.struct(F.col("owner").alias("login")).alias("owner"), F.col("repo").alias("name"), F.col("stars").alias("stargazers_count"), F.col("url").alias("html_url"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "language")
    pages = load(spark, folder, "repositories").groupBy((F.col("id") % PAGES).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("value"))
    pages.repartition("page").write.partitionBy("page").text(path)
    spark.dataSource.register(SearchSource)
    rows = spark.read.format("repository_search").option("path", path.removeprefix("file://") + "/page=*/part-*").option("least", LEAST).option("most", 100).load()
    return rows.select("id", "owner", "repo", "stars", "url", "language")


def stream_new_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger as a stream, in files one after another, each id once."""
    base = scratch(spark)
    ledger_lines(spark, folder).repartition(4).write.text(base + "/in")
    streams.write_new(streams.new_rows(streams.ledger_stream(spark, base + "/in", 2)), base + "/out", base + "/check").awaitTermination()
    return spark.read.schema("id bigint, owner string, repo string").json(base + "/out").filter("id IS NOT NULL").select("id")


def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of releases streamed into a versioned table; its newest rows."""
    base, schema = scratch(spark), TABLES["releases"]
    load(spark, folder, "releases").select(*schema.names).repartition(3).write.parquet(base + "/in")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    streams.upsert(rows, base + "/table", base + "/check").awaitTermination()
    return streams.current(spark, base + "/table", "releases").select("repository_id", "tag_name", "source", "updated_at")


def table_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Releases appended twice to a table of the catalogue, compacted to their newest rows."""
    base = scratch(spark)
    database = "billow_" + base.rsplit("-", 1)[-1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{base}/db'")
    try:
        sinks.create_tables(spark, database)
        sinks.reset_tables(spark, database)
        for _ in range(2):
            sinks.append(load(spark, folder, "releases"), database, "releases")
        sinks.compact(newest(spark.table(f"{database}.releases"), KEYS["releases"]), base + "/compact", "releases")
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.read.schema(TABLES["releases"]).parquet(base + "/compact").select("repository_id", "tag_name", "source", "updated_at")


def folder_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Endpoints from all the files of a folder, each a JSON array for one type of event."""
    path = scratch(spark) + "/files"
    endpoint = F.struct(F.col("event_type").alias("method"), F.concat(F.lit("/v/"), F.floor("value").cast("string")).alias("path"))
    rows = load(spark, folder, "events").groupBy(F.col("event_type").alias("kind"), (F.col("event_id") % 2).alias("odd")).agg(F.to_json(F.collect_set(endpoint)).alias("value"))
    rows.repartition("kind", "odd").write.partitionBy("kind", "odd").text(path)
    found = files.folder_files(spark, path, "*.txt").select(F.from_json(F.col("content").cast("string"), "array<struct<method string, path string>>").alias("all"))
    return found.select(F.explode("all").alias("e")).select("e.method", "e.path").distinct()


def tree_files(spark: SparkSession, folder: str) -> DataFrame:
    """File trees of commits, a folder each."""
    path = scratch(spark) + "/trees"
    sinks.write_trees(trees(spark, folder).drop("position"), path)
    return files.tree_table(spark, path)


def truth_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Endpoints in code from <owner>/<repo>/<tag>.json: a file for each type of event."""
    path = scratch(spark) + "/truth"
    endpoint = F.struct(F.col("event_type").alias("method"), F.concat(F.lit("/v/"), F.floor("value").cast("string")).alias("path"))
    rows = load(spark, folder, "events").groupBy((F.col("event_id") % 2).alias("odd"), F.col("event_type").alias("kind")).agg(F.to_json(F.collect_set(endpoint)).alias("value"))
    rows.repartition("odd", "kind").write.partitionBy("odd", "kind").text(path)
    # Spark gives its files names of its own; here a file is named by its tag.
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/*/part-*")):
        system.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(status.getPath().getParent(), "v1.0.json"))
    return files.truth_files(spark, path)


def release_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Saved pages of releases, 16 of them, with tags that have no release beside them."""
    path = scratch(spark) + "/pages"
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    item = F.struct("tag_name", "name", F.col("is_prerelease").alias("prerelease"), F.col("is_draft").alias("draft"), at("published_at"), at("created_at"), "target_commitish")
    rows = warehouse(spark, folder).final("releases").filter("source = 'github_release'")
    rows.groupBy((F.coalesce("repository_id", F.lit(0)) % PAGES).alias("page")).agg(F.to_json(F.collect_list(item)).alias("value")).repartition("page").write.partitionBy("page").text(path)
    found = files.release_pages(spark, path)
    return found.withColumn("page", F.regexp_extract("page", r"(\d+)", 1).cast("bigint"))


def classification_records(spark: SparkSession, folder: str) -> DataFrame:
    """Flat records through a CSV file into the nested form, and some of its fields."""
    path = scratch(spark) + "/flat"
    sinks.write_csv(classification_flat(spark, folder).drop("description", "topics"), path)
    found = classify.records(files.csv_text(spark, path))
    field = lambda name: F.get_json_object("record", f"$.{name}")
    return found.select("owner", "repo", field("category").alias("category"), field("primary_framework").alias("framework"), field("description.zh").alias("zh"), field("tags").alias("tags"))


def context_windows(spark: SparkSession, folder: str) -> DataFrame:
    return dims.context_windows(spark, {"small": 1000, "odd": 4097, "large": 128_000})


def json_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as JSON, and a description as a table shows it."""
    rows = warehouse(spark, folder).final("repositories", "id", "owner", "stars", "description")
    return sinks.as_json(rows.select("id", "owner", "stars", capped(F.regexp_replace("description", r'["\\\\]', ""), F.lit("description")).alias("description")))


def sbom_checks(spark: SparkSession, folder: str) -> DataFrame:
    """kind, problem of SBOM files: one for each kind of document, of which some are none."""
    path = scratch(spark) + "/sboms"
    kinds = load(spark, folder, "documents").select("source").distinct()
    text = F.when(F.length("source") % 3 == 0, "no json").when(F.length("source") % 3 == 1, '{"other": 1}').otherwise('{"artifacts": []}')
    kinds.select("source", text.alias("value")).repartition("source").write.partitionBy("source").text(path)
    return checks.sbom_problems(spark, path).select(F.regexp_extract("file", r"source=([^/]+)", 1).alias("kind"), "problem")


def language_extensions(spark: SparkSession, folder: str) -> DataFrame:
    return dims.extensions(spark)


def framework_order(spark: SparkSession, folder: str) -> DataFrame:
    return dims.framework_packages(spark).select("language", "framework", F.col("priority").cast("bigint").alias("priority")).distinct()


def observed_counters(spark: SparkSession, folder: str) -> DataFrame:
    """rows, named: counted while the table is written, without another pass."""
    rows, watch = checks.observed(load(spark, folder, "artifacts"), "artifacts", rows=F.count(F.lit(1)), named=F.count("name"))
    rows.write.format("noop").mode("overwrite").save()
    found = watch.get
    return spark.createDataFrame([(found["rows"], found["named"])], "rows bigint, named bigint")


def list_checks(spark: SparkSession, folder: str) -> DataFrame:
    """problem: what a list lacks, by its first line; the list has one spelling of each field only."""
    path = scratch(spark) + "/list"
    rows = load(spark, folder, "repositories").select("id", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("name"))
    sinks.as_json(rows).write.text(path)
    problems = [*checks.list_problems(spark, path), *checks.list_problems(spark, path + "-none")]
    return spark.createDataFrame([(p,) for p in problems], "problem string")


def adapted_names(spark: SparkSession, folder: str) -> DataFrame:
    """id, owner, name of rows that have both in one field."""
    rows = keep_first(load(spark, folder, "repositories").select("id", "owner", "repo", "updated_at"), ["id"], [F.desc_nulls_last("updated_at"), F.asc("owner"), F.asc("repo")])
    given = rows.select("id", F.concat(F.coalesce("owner", F.lit("nobody")), F.lit("/"), F.coalesce("repo", F.lit("nothing"))).alias("repo_name"))
    return classify.adapted(given).select("id", "owner", "name")


QUERIES = {
    f.__name__: f
    for f in (
        ledger_rows, ledger_failures, ledger_resume, ledger_may_stop, ledger_text_lines, ledger_append, sbom_artifacts, csv_texts, csv_types, search_pages,
        stream_new_ids, stream_upsert, table_versions, folder_contents, tree_files, truth_endpoints, release_pages, classification_records, context_windows, json_rows, sbom_checks, language_extensions, framework_order, observed_counters, list_checks, adapted_names,
    )
}
CLASSIFIED = f"""WITH f AS ({DATAFLOW["classification_flat"]})
    SELECT owner, repo, category, nullif(framework, '') AS framework, description_zh AS zh, CASE WHEN tags = '' THEN '[]' ELSE '["' || replace(tags, ', ', '","') || '"]' END AS tags FROM f"""
NEWEST_RELEASES = "SELECT repository_id, tag_name, source, updated_at FROM releases QUALIFY row_number() OVER (PARTITION BY repository_id, tag_name ORDER BY updated_at DESC NULLS LAST) = 1"
SQL = {
    "ledger_rows": "SELECT id, coalesce(owner, '') AS owner, repo, stars, url, coalesce(is_fork, false) AS is_fork, 'main' AS default_branch FROM repositories",
    "ledger_failures": "SELECT count(*) + 1 AS lines, CAST(1 AS BIGINT) AS failed, count(id) AS keyed FROM repositories",
    "ledger_resume": "SELECT count(DISTINCT id) AS ids, min(stars) AS least_stars FROM repositories",
    "ledger_may_stop": "SELECT least, (SELECT min(stars) FROM repositories) <= least AS stop FROM (VALUES (-1::BIGINT), (0), (1000000)) AS v(least)",
    "ledger_text_lines": "SELECT count(*) + 1 AS lines, count(*) + 1 AS objects FROM repositories",
    "ledger_append": "SELECT id, owner, repo FROM repositories QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at NULLS LAST, stars NULLS FIRST, license_name NULLS FIRST) = 1",
    "sbom_artifacts": """SELECT repository_id % 64 AS repository_id, coalesce(artifact_id, '') AS artifact_id, coalesce(name, '') AS name, coalesce(version, '') AS version, coalesce(type, '') AS type, coalesce(purl, '') AS purl,
        coalesce(found_by, '') AS found_by, coalesce(array_to_string([x FOR x IN licenses IF x IS NOT NULL AND x <> ''], ';'), '') AS licenses, 'main' AS sbom_ref, 'sha' AS sbom_commit_sha FROM artifacts WHERE repository_id IS NOT NULL""",
    "csv_texts": FINAL + "SELECT CAST(id AS VARCHAR) AS id, owner, CAST(stars AS VARCHAR) AS stars, description, CASE WHEN is_fork THEN 'True' ELSE 'False' END AS is_fork FROM r",
    "csv_types": "SELECT DISTINCT repository_id, release_id, coalesce(tag_name, '') AS tag_name FROM releases",
    "search_pages": f"SELECT id, owner, repo, stars, url, language FROM repositories WHERE coalesce(stars, 0) >= {LEAST}",
    "stream_new_ids": "SELECT DISTINCT id FROM repositories",
    "stream_upsert": NEWEST_RELEASES,
    "table_versions": NEWEST_RELEASES,
    "folder_contents": "SELECT DISTINCT event_type AS method, '/v/' || CAST(floor(value) AS BIGINT) AS path FROM events",
    "tree_files": FINAL + f"""SELECT language, owner, repo, coalesce(nullif(latest_release_tag, ''), default_branch) AS ref, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE sbom_commit_sha END AS sha, {TREE_PATH} AS path
        FROM (SELECT doc_id, repository_id FROM documents) d JOIN r ON d.repository_id = r.id""",
    "truth_endpoints": "SELECT DISTINCT 'odd=' || (event_id % 2) AS owner, 'kind=' || event_type AS repo, 'v1.0' AS tag, event_type AS method, '/v/' || CAST(floor(value) AS BIGINT) AS path FROM events",
    "release_pages": FINAL + f"""SELECT coalesce(repository_id, 0) % {PAGES} AS page, tag_name, name, is_prerelease, is_draft, date_trunc('second', published_at) AS published_at, date_trunc('second', created_at) AS created_at, target_commitish
        FROM l WHERE source = 'github_release'""",
    "classification_records": CLASSIFIED,
    "context_windows": "SELECT model, CAST(floor(size * 0.9) AS BIGINT) AS tokens FROM (VALUES ('small', 1000), ('odd', 4097), ('large', 128000)) AS m(model, size)",
    "json_rows": FINAL + """SELECT '{"id":' || id || ',"owner":"' || owner || '","stars":' || stars || ',"description":"' || left(regexp_replace(description, '["\\\\]', '', 'g'), 50) || '"}' AS value FROM r""",
    "sbom_checks": """SELECT source AS kind, CASE WHEN length(source) % 3 = 0 THEN 'no JSON object' ELSE 'neither artifacts nor components' END AS problem
        FROM (SELECT DISTINCT source FROM documents) WHERE length(source) % 3 < 2""",
    "language_extensions": f"SELECT l AS language, unnest(ends) AS extension FROM {ENDS}",
    "framework_order": """SELECT language, framework, CAST(priority AS BIGINT) AS priority FROM (VALUES ('go', 'gin', 0), ('go', 'echo', 1), ('python', 'flask', 0), ('python', 'django', 1), ('python', 'fastapi', 2), ('java', 'springboot', 0),
        ('rust', 'actix', 0), ('ruby', 'rails', 0), ('node', 'express', 0), ('javascript', 'express', 0), ('typescript', 'express', 0), ('php', 'laravel', 0), ('php', 'symfony', 1)) AS f(language, framework, priority)""",
    "observed_counters": "SELECT count(*) AS rows, count(name) AS named FROM artifacts",
    "list_checks": "SELECT problem FROM (VALUES ('no field stargazers_count'), ('no field html_url'), ('no field created_at'), ('no such file')) AS p(problem)",
    "adapted_names": "SELECT id, coalesce(owner, 'nobody') AS owner, coalesce(repo, 'nothing') AS name FROM repositories QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, owner, repo) = 1",
}
