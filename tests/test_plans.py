import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from billow import dims
from billow.plans import collect, openapi
from billow.plans.export import projects
from billow.plans.warehouse import Warehouse, adhoc, missing_tables
from billow.schemas import ARTIFACTS, RELEASES, REPOSITORIES

AT = dt.datetime(2024, 1, 1)


def table(spark, schema, items):
    return spark.createDataFrame([tuple(item.get(f.name) for f in schema) for item in items], schema)


@pytest.fixture(scope="module")
def house(spark):
    repositories = table(spark, REPOSITORIES, [
        {"id": 1, "owner": "A", "repo": "One", "stars": 9, "language": "Python", "default_branch": "main", "latest_release_tag": "v1", "url": "u1", "updated_at": AT},
        {"id": 1, "owner": "A", "repo": "Old", "stars": 1, "language": "Go", "updated_at": AT - dt.timedelta(1)},
        {"id": 2, "owner": "B", "repo": "Two", "stars": 5, "language": "python", "default_branch": "main", "sbom_commit_sha": "abc", "url": "u2", "updated_at": AT},
        {"id": 3, "owner": "C", "repo": "Three", "stars": None, "language": "cobol", "updated_at": AT},
    ])
    names = [(1, "flask", "2.0"), (1, "django", "4"), (1, "flasgger", "1"), (2, "flask", "1"), (2, "fastapi", "0.1"), (2, "pydantic", "2"), (2, "100%_a\\b", "1"), (9, "flask", "1")]
    artifacts = table(spark, ARTIFACTS, [{"repository_id": r, "artifact_id": n, "name": n, "version": v, "type": "python", "updated_at": AT} for r, n, v in [*names, names[0]]])
    return Warehouse(repositories, artifacts, table(spark, RELEASES, []), dims.framework_packages(spark))


def test_counts_and_search(house):
    assert rows(house.stats()) == [(3, 8)]
    assert rows(house.languages()) == [("Python", 1), ("cobol", 1), ("python", 1)]
    assert house.top_dependencies(1).collect()[0][:] == ("flask", 3)
    assert rows(house.search("FLASK")) == [("A", "One", "flask", "2.0"), ("B", "Two", "flask", "1")]
    assert rows(house.search("%_A\\b")) == [("B", "Two", "100%_a\\b", "1")]
    assert rows(house.search("nothing")) == []
    assert rows(house.candidates("flask", "python")) == [("flask", 1, 1)]
    assert rows(house.dependent_count("flask")) == [(2,)] and rows(house.dependent_count("flask", "Python")) == [(1,)]
    assert [r.repo for r in house.dependents("flask").collect()] == ["One", "Two"]
    assert rows(house.framework_usage("python", ["flask"])) == [(2,)]
    assert rows(house.top_projects("python", ["flask"], 1)) == [("A", "One", 9, "u1")]
    assert ("flask", "2.0") in [(r.framework, r.version) for r in house.repository_frameworks(1).collect()]
    stats = {(r.language, r.framework): (r.repositories, r.samples) for r in house.framework_stats().collect()}
    assert stats[("python", "flask")] == (2, "A/One;B/Two") and stats[("rust", "actix")] == (0, "")


def test_export_takes_frameworks_by_priority(house):
    out = {r.repo: r.framework for r in projects(house).collect()}
    assert out == {"One": "flask", "Two": "flask", "Three": ""}
    assert projects(house, web_only=True).count() == 2


def test_candidates(spark, house):
    files = spark.createDataFrame([("Python", "a", "ONE", "v1", "", "docs/openapi.yaml", 0), ("python", "a", "ONE", "v1", "", "tests/openapi.json", 1), ("python", "a", "one", "v1", "other", "openapi.json", 2), ("go", "a", "one", "v1", "", "openapi.json", 3)], "language string, owner string, repo string, ref string, sha string, path string, position int")
    out = {(r.repo, r.framework): r for r in openapi.candidates(house, files, dims.commands(spark)).collect()}
    assert set(out) == {("one", "flask"), ("one", "django"), ("two", "fastapi")}  # flask is excluded where there is fastapi
    row = out[("one", "flask")]
    assert (row.openapi_file, row.matched_dependencies, row.generation_command) == ("docs/openapi.yaml", "flasgger", "flask spec")
    assert row.url == "https://github.com/a/one/releases/tag/v1" and row.openapi_url == "https://github.com/a/one/blob/v1/docs/openapi.yaml"
    assert out[("two", "fastapi")].generation_command.startswith("python -c")
    stats = {r.framework: r for r in openapi.candidate_stats(openapi.candidates(house, files), spark.createDataFrame([("flask", 2), ("gin", 0)], "framework string, total long")).collect()}
    assert (stats["flask"].both, stats["flask"].percentage, stats["gin"].percentage, stats["TOTAL"].total) == (1, 50.0, 0.0, 2)


@pytest.mark.parametrize(("path", "kept"), [("openapi.yaml", True), ("tests/openapi.yaml", False), ("my-test/swagger.json", False), ("examples_old/api.yml", False), ("API.YAML", True), ("src/readme.md", False)])
def test_file_filter(spark, path, kept):
    assert openapi.description_files(spark.createDataFrame([(path,)], "path string")).count() == kept


def test_best_files(spark):
    df = spark.createDataFrame([("r", "x/api.yml", 0, 5), ("r", "swagger.json", 1, 3), ("r", "openapi.yaml", 2, 9)], "g string, path string, position int, length long")
    assert openapi.best_file(df, ["g"]).first().path == "swagger.json"
    assert openapi.best_spec(df, ["g"]).first().path == "swagger.json"


def test_specs_and_drift(spark):
    text = '{"paths": {"/A/{id}/": {"get": {}, "x": 1, "POST": {}}, "b": 3}}'
    specs = spark.createDataFrame([("o", "r", "t", text), ("o", "r", "t", "no json"), ("o", "e", "t", None)], "owner string, repo string, tag string, content string")
    found = openapi.spec_endpoints(specs, ["owner", "repo", "tag"])
    assert rows(found.select("method", "path")) == [("GET", "/a/{}"), ("POST", "/a/{}")]
    projects_ = spark.createDataFrame([("go", "gin", "o", r, 1, "t", "f") for r in ("r", "none")], "language string, framework string, owner string, repo string, stars int, tag string, openapi_file string")
    truth = spark.createDataFrame([("o", "r", "t", "get", "/a/:x"), ("o", "r", "t", "get", "/c")], "owner string, repo string, tag string, method string, path string")
    out = {r.repo: r for r in openapi.drift(projects_, truth, found).collect()}
    assert (out["r"].implemented_endpoints, out["r"].documented_endpoints, out["r"].precision, out["r"].recall, out["r"].f1_score) == (2, 2, 0.5, 0.5, 0.5)
    assert (out["none"].implemented_endpoints, out["none"].f1_score) == (0, 0.0)


def test_releases_and_refs(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    schema = "repository_id int, tag_name string, name string, is_prerelease boolean, is_draft boolean, published_at timestamp, created_at timestamp, target_commitish string"
    releases = spark.createDataFrame([(1, "v1", "", False, False, t(1), None, ""), (1, "v2-rc", "", True, False, t(9), None, ""), (2, "x", "", True, False, None, None, "")], schema)
    tags = spark.createDataFrame([(1, "v1", "s", t(5)), (1, "v0", "s0", None)], "repository_id int, tag_name string, sha string, date timestamp")
    all_ = collect.merged_releases(releases, tags)
    assert rows(all_.select("repository_id", "tag_name", "source")) == [(1, "v0", "git_tag"), (1, "v1", "github_release"), (1, "v2-rc", "github_release"), (2, "x", "github_release")]
    assert rows(collect.latest_stable(all_).select("repository_id", "tag_name")) == [(1, "v1")]
    assert {r.repository_id: (r.total_releases, r.latest_tag) for r in collect.release_summary(all_).collect()} == {1: (3, "v1"), 2: (1, "")}
    lines = spark.createDataFrame([(1, "aa refs/tags/v1"), (1, "bb refs/tags/v1^{}"), (1, "cc\trefs/heads/main"), (1, "cc HEAD"), (1, "junk")], "id int, value string")
    refs = collect.refs_of_lines(lines, ["id"])
    assert rows(refs) == [(1, "HEAD", "cc"), (1, "refs/heads/main", "cc"), (1, "refs/tags/v1", "bb")]
    assert rows(collect.tags_of_refs(refs, ["id"])) == [(1, "v1", "bb")]
    repos = spark.createDataFrame([(1, "v1", "main"), (1, "v9", "main"), (2, "", "main")], "id int, rel string, branch string")
    assert rows(collect.resolved(repos, refs, "id", "rel", "branch").select("rel", "target_ref", "target_type", "commit_sha")) == [("", "main", "branch", ""), ("v1", "v1", "release", "bb"), ("v9", "main", "branch", "cc")]


def test_sizes(spark):
    files = spark.createDataFrame([("r", "a.go", "x\ny", 3), ("r", "tests/b.go", "z", 1), ("r", "big.go", "q", 2 << 20), ("r", "p.png", None, 6)], "g string, path string, text string, length long")
    assert rows(openapi.source_stats(files.withColumn("language", F.lit("go")), ["g"], size="length").select("lines", "files")) == [(2, 2)]
    assert rows(openapi.tree_sizes(files.filter("length < 100"), ["g"])) == [("r", 10, 3, 70.0)]
    windows = spark.createDataFrame([("m", 5)], "model string, tokens long")
    assert rows(openapi.context_fit(spark.createDataFrame([("r", 5), ("s", 6)], "g string, tokens long"), windows, ["m"])) == [("r", 5, True), ("s", 6, False)]


def test_adhoc_is_read_only(spark, house):
    assert house.register(spark) == ["repositories", "artifacts", "releases"]
    assert adhoc(spark, "WITH x AS (SELECT 1 AS one) SELECT one FROM x WHERE one = :n", {"n": 1}).collect()[0].one == 1
    assert adhoc(spark, "-- note\nSELECT count(*) AS n FROM repositories WHERE owner = 'drop table'").first().n == 0
    for text in ("DROP TABLE repositories", "INSERT INTO repositories SELECT * FROM repositories", "CREATE TABLE x AS SELECT 1", "WITH x AS (SELECT 1) INSERT INTO y SELECT * FROM x", "SET a=b", "SHOW TABLES; DROP VIEW x"):
        with pytest.raises(PermissionError):
            adhoc(spark, text)
    assert missing_tables(spark) == set()


def test_plan_reads_only_what_it_needs(spark, data):
    from billow.queries.warehouse import warehouse

    plan = warehouse(spark, data).top_dependencies()._jdf.queryExecution().toString()
    assert "ReadSchema: struct<repository_id:bigint,name:string>" in plan and "TakeOrderedAndProject" in plan
    text = warehouse(spark, data).of_library("x", None)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_listed_frameworks_have_the_fixed_order(spark):
    packages = [("python", f, f, "core") for f in ("aiohttp", "fastapi", "django", "flask")] + [("php", "symfony", "x", "core"), ("php", "laravel", "y", "core")]
    found = dims.ranked(spark.createDataFrame(packages, "language string, framework string, package_name string, usage string")).collect()
    order = sorted((r.language, r.priority, r.framework) for r in found)
    assert [x[2] for x in order] == ["laravel", "symfony", "flask", "django", "fastapi", "aiohttp"]


def test_sources_by_language(spark):
    files = [("go", "a/x.GO"), ("go", "x.py"), ("go", "go.sum"), ("cobol", "x.py"), ("cobol", "x.kt"), (None, "x.rs"), ("Java", "x.kt"), ("python", "tests/x.py"), ("python", ".py"), ("python", "x.test.py"), ("node", "x.mjs")]
    df = spark.createDataFrame([(k, language, path, "a b\nc") for k, (language, path) in enumerate(files)], "k int, language string, path string, text string")
    out = {r.k: (r.lines, r.files) for r in openapi.source_stats(df, ["k"]).collect()}
    assert sorted(out) == [0, 3, 5, 6, 9, 10] and set(out.values()) == {(2, 1)}


def test_long_files_count_as_nothing_by_their_bytes(spark):
    df = spark.createDataFrame([(1, "go", "x.go", "é" * 600), (2, "go", "x.go", "e" * 600), (3, "go", "x.go", None)], "k int, language string, path string, text string")
    assert {r.k: (r.lines, r.files) for r in openapi.source_stats(df, ["k"], most=1000).collect()} == {1: (0, 1), 2: (1, 1), 3: (0, 1)}


def test_bpe_counts_as_a_second_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    from billow.functions.tokens import bpe_count

    texts = ["def main():\n    return 1\n", "<|endoftext|>", "", None, "naïve 文字", "x" * 500]
    other = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.n for r in df.select("k", bpe_count(spark, F.col("t")).alias("n")).collect()}
    assert got == {k: len(other.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
