import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from billow import dims
from billow.sinks import tables as sinks
from billow.sources import files
from billow.sources.search import SearchSource, day_ranges, star_ranges
from billow.streaming import ledger as streams

def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")



@pytest.fixture
def ledger_file(tmp_path):
    lines = [
        {"id": 1, "owner": {"login": "me"}, "name": "one", "stargazers_count": 5, "html_url": "u", "created_at": "2024-06-03T23:37:33Z", "description": None, "extra": 1, "license": {"spdx_id": "MIT", "name": "MIT License"},
         "all_releases": [{"tag_name": "v1", "prerelease": True, "published_at": "never", "assets": [{"n": "x"}]}], "download_target": {"ref": "v1", "ref_type": "release", "commit_sha": "0123456789"}},
        {"id": 2, "owner": "you", "repo": "two", "stars": 7, "default_branch": "dev", "is_fork": True},
        {"id": 1, "owner": "later", "repo": "x"},
    ]
    path = tmp_path / "ledger.jsonl"
    path.write_text("\n".join([json.dumps(lines[0]), "", json.dumps(lines[1]), "{broken", json.dumps(lines[2])]))
    return str(path)


def test_ledger(spark, ledger_file, tmp_path):
    raw = files.json_lines(spark, ledger_file)
    assert rows(files.failed_lines(raw)) == [(4, 1, 3)]
    clean = files.ledger(raw)
    assert rows(clean.select("id", "owner", "repo", "stars", "default_branch", "license_spdx_id")) == [(1, "later", "x", None, "main", ""), (1, "me", "one", 5, "main", "MIT"), (2, "you", "two", 7, "dev", "")]
    table = {r.owner: r for r in files.repository_rows(clean, now()).collect()}
    assert table["me"].created_at == dt.datetime(2024, 6, 3, 23, 37, 33) and table["me"].description == "" and table["me"].sbom_commit_sha_short == "0123456"
    assert table["you"].created_at == dt.datetime(1970, 1, 2) and table["you"].is_fork
    release = files.release_rows(clean, now()).collect()[0]
    assert release.is_prerelease and release.published_at == dt.datetime(1970, 1, 2) and json.loads(release.release_assets) == [{"n": "x"}]
    assert files.json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    assert rows(files.seen_and_least(clean)) == [(2, 5)]


def test_sboms(spark, tmp_path):
    folder = tmp_path / "sbom"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"artifacts": [{"id": "i", "name": "n", "version": None, "foundBy": "f", "licenses": ["MIT", {"value": "", "spdxExpression": "Apache-2.0"}, {}]}]}, indent=1))
    (folder / "b.json").write_text("not json")
    elements = files.sboms(spark, str(folder))
    repositories = spark.createDataFrame([(f"{folder}/a.json", 7, "v1", "sha")], "sbom_file string, id long, sbom_ref string, sbom_commit_sha string")
    row = files.artifact_rows(elements, repositories, now()).collect()
    assert [(r.repository_id, r.name, r.version, r.found_by, r.licenses) for r in row] == [(7, "n", "", "f", ["MIT", "Apache-2.0"])]
    assert files.sboms(spark, str(tmp_path / "missing")).count() == 0


def test_trees_truth_and_csv(spark, tmp_path):
    tree = tmp_path / "trees/go/o/r/v1/s"
    tree.mkdir(parents=True)
    (tree / "tree.txt").write_text("a.go\n\n  b/openapi.yaml \n")
    assert rows(files.trees(spark, str(tmp_path / "trees"))) == [("go", "o", "r", "v1", "s", "a.go"), ("go", "o", "r", "v1", "s", "b/openapi.yaml")]
    truth = tmp_path / "truth/o/r"
    truth.mkdir(parents=True)
    (truth / "v1.0.json").write_text('[{"method": "GET", "path": "/a"}]')
    assert rows(files.truth_files(spark, str(tmp_path / "truth"))) == [("o", "r", "v1.0", "GET", "/a")]
    df = spark.createDataFrame([("a,b", True, ""), ('q"x', False, "y")], "t string, b boolean, e string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert rows(files.csv_text(spark, str(tmp_path / "csv"))) == [("a,b", "True", ""), ('q"x', "False", "y")]
    assert files.folder_files(spark, str(tmp_path / "truth"), "*.json").count() == 1
    assert files.check_columns(df, ["t", "z"]) == ["z"]
    sinks.write_trees(spark.createDataFrame([("go", "o", "r", "v1", "s", "x.go")], "language string, owner string, repo string, ref string, sha string, path string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == "x.go"
    assert sinks.as_json(df).count() == 2


def test_a_tree_is_one_file_and_comes_back_whole(spark, tmp_path):
    odd = ["", None, "a/b", "50%", "x=y", "ü{1}^[2]", "q'\"*?:#\\", "__x", ".h", " s ", "%41"]
    trees = [("go", f"o{k % 3}", f"r{k}", odd[k % len(odd)], odd[k // 7 % len(odd)]) for k in range(60)]
    given = [(*t, f"{k}/ä.go") for t in trees for k in range(8)] + [("go", "o", "r", "v", "s", p) for p in ("", None, " t.go ", "t.go", "u\rv")]
    schema = "language string, owner string, repo string, ref string, sha string, path string"
    root = str(tmp_path / "trees")
    for _ in range(2):  # the second time it is replaced
        sinks.write_trees(spark.createDataFrame(given, schema).repartition(4), root)
    expected = [(*[v or "" for v in t], p.strip()) for *t, text in given for p in (text or "").split("\r") if p.strip()]
    assert rows(files.tree_table(spark, root)) == sorted(expected, key=repr)
    assert sum(p.is_file() for p in (tmp_path / "trees/language=go").rglob("*")) == 61  # before: one for each task, and a checksum beside each
    # Spark's own reader finds the same
    by_spark = spark.read.schema(schema.replace("path", "value")).text(root).select(*[F.coalesce(c, F.lit("")).alias(c) for c in files.TREE], F.trim("value").alias("path")).filter("path <> ''")
    assert rows(by_spark) == sorted(expected, key=repr)
    # a folder can be written again from itself, and is left as it is where that fails
    sinks.write_trees(files.tree_table(spark, root).filter("owner = 'o'"), root)
    assert [r[5] for r in rows(files.tree_table(spark, root))] == ["t.go", "t.go", "u", "v"]
    with pytest.raises(Exception, match="no tree"):
        sinks.write_trees(files.tree_table(spark, root).withColumn("path", F.raise_error(F.lit("no tree")).cast("string")), root)
    assert files.tree_table(spark, root).count() == 4
    assert [p.name for p in tmp_path.iterdir()] == ["trees"]
    sinks.write_trees(spark.createDataFrame([], schema), root)
    assert files.tree_table(spark, root).count() == 0
    (tmp_path / "trees/go/o").mkdir(parents=True)  # another layout is no empty table
    with pytest.raises(Exception, match="is no folder language="):
        files.tree_table(spark, root).count()


def test_append_ledger_keeps_first(spark, tmp_path):
    path = str(tmp_path / "l")
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 2)], "id int, v string, seq int")
    sinks.append_ledger(df, path, "id", [F.asc("seq")])
    sinks.append_ledger(spark.createDataFrame([(1, "z", 0), (3, None, 1)], "id int, v string, seq int"), path, "id", [F.asc("seq")])
    assert rows(spark.read.schema("id int, v string").json(path)) == [(1, "a"), (2, "c"), (3, None)]


def test_warehouse_tables(spark, ledger_file):
    sinks.reset_tables(spark, "billow_test")
    clean = files.ledger(files.json_lines(spark, ledger_file))
    sinks.append(files.repository_rows(clean, now()), "billow_test", "repositories")
    sinks.create_tables(spark, "billow_test")
    assert spark.table("billow_test.repositories").count() == 3
    sinks.reset_tables(spark, "billow_test")
    assert spark.table("billow_test.repositories").count() == 0
    spark.sql("DROP DATABASE billow_test CASCADE")


def test_stream_resumes(spark, ledger_file, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(open(ledger_file).read())
    run = lambda: streams.write_new(streams.new_rows(streams.ledger_stream(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (folder / "2.json").write_text('{"id": 2, "owner": "again", "repo": "r"}\n{"id": 3, "owner": "new", "repo": "r"}\n')
    run()
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).select("id").collect()) == [1, 2, 3]


def test_search_source(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"items": [{"id": i, "owner": {"login": "a"}, "name": "b", "stargazers_count": i % 4 + 1, "html_url": "h"} for i in range(20)]}))
    spark.dataSource.register(SearchSource)
    df = spark.read.format("repository_search").option("path", str(tmp_path / "p*.json")).option("least", 2).option("most", 6).load()
    assert df.count() == 15 and df.rdd.getNumPartitions() == 3
    assert star_ranges({10: 400, 9: 400, 8: 400, 5: 1}, 5) == [(9, None), (5, 8)]
    days = {dt.date(2024, 1, d): 400 for d in range(1, 9)}
    assert all(sum(n for d, n in days.items() if a <= d <= b) < 1000 for a, b in day_ranges(days, dt.date(2024, 1, 1), dt.date(2024, 1, 8)))


def test_search_source_splits_a_hot_star_value_by_days(spark, tmp_path):
    made = [f"2024-01-{d:02}T00:00:00Z" for d in range(1, 17)] + [None, "", "soon"]
    items = [{"id": i, "name": "b", "stargazers_count": 7, "created_at": day} for i, day in enumerate(made)] + [{"id": 100 + s, "name": "c", "stargazers_count": s} for s in (3, 7, 9)]
    (tmp_path / "p.json").write_text(json.dumps({"items": items}))
    spark.dataSource.register(SearchSource)
    df = spark.read.format("repository_search").option("path", str(tmp_path / "p.json")).option("most", 6).load()
    assert sorted(r.id for r in df.collect()) == sorted(x["id"] for x in items)
    held = df.rdd.glom().map(lambda part: sorted({r.stars for r in part})).collect(), df.rdd.glom().map(len).collect()
    assert max(held[1]) < 6 and sum(held[1]) == len(items) and len(held[1]) == 7 and held[0].count([7]) == 5


def test_yaml_needs_a_module(spark):
    specs = spark.createDataFrame([("a", '{"paths": {}}'), ("b", "paths:\n  /x:\n    get: {}\n")], "k string, content string")
    out = dict(tuple(r) for r in files.yaml_to_json(specs, ["k"]).collect())
    assert out["a"] == '{"paths": {}}'
    try:
        import yaml  # noqa: F401
    except ImportError:
        assert out["b"] is None
    else:
        assert json.loads(out["b"]) == {"paths": {"/x": {"get": {}}}}


def test_dimensions(spark):
    assert len(dims.FRAMEWORKS) == 11 and len(dims.LANGUAGES) == 9 and len(dims.OPENAPI_FILES) == 18 and len(dims.IGNORED_DIRECTORIES) == 28
    assert dims.FRAMEWORKS["flask"][3] == ["fastapi"]
    assert rows(dims.context_windows(spark, {"m": 1001})) == [("m", 900)]
    assert dims.extensions(spark).filter("extension = '.kt'").first().language == "java"
