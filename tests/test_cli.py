import json

from billow.__main__ import main
from billow.sources.files import csv_text


def test_index_query_export(spark, tmp_path, capsys):
    sboms = tmp_path / "sboms"
    sboms.mkdir()
    (sboms / "a.json").write_text(json.dumps({"artifacts": [{"id": "1", "name": "flask", "version": "2", "type": "python"}, {"id": "2", "name": "flasgger", "version": "1"}]}))
    ledger = tmp_path / "l.jsonl"
    ledger.write_text(json.dumps({"id": 1, "owner": "o", "repo": "r", "stars": 9, "language": "Python", "sbom_path": f"{sboms}/a.json", "all_releases": [{"tag_name": "v1"}]}) + "\n{bad\n")
    house = ["--warehouse", str(tmp_path / "w")]
    run = lambda *argv: main([*house, *argv], spark)
    run("db", "index", str(ledger), "--sboms", str(sboms))
    assert "|    2|     1|    1|" in capsys.readouterr().out
    run("db", "status")
    run("db", "query", "FLAS", "--limit", "5")
    out = capsys.readouterr().out
    assert "flasgger" in out and "o/r" in out
    run("db", "export", "--output", str(tmp_path / "p"), "--web-only")
    assert csv_text(spark, str(tmp_path / "p")).first().framework == "flask"
    run("openapi", "candidates", "--output", str(tmp_path / "c"))
    row = csv_text(spark, str(tmp_path / "c")).first()
    assert (row.matched_dependencies, row.has_openapi_deps, row.generation_command) == ("flasgger", "True", "flask spec")
    run("db", "sql", "SELECT count(*) AS n FROM artifacts")
    assert "2|" in capsys.readouterr().out


def test_drift_and_paths(spark, tmp_path):
    spec = tmp_path / "specs/o/r/v1/docs"
    spec.mkdir(parents=True)
    (spec / "openapi.json").write_text('{"paths": {"/A/{x}": {"get": {}, "put": {}}}}')
    truth = tmp_path / "truth/o/r"
    truth.mkdir(parents=True)
    (truth / "v1.json").write_text('[{"method": "GET", "path": "/a/:y"}]')
    table = tmp_path / "c.csv"
    table.write_text("language,framework,owner,repo,stars,default_branch,latest_release,commit_sha,openapi_file\npython,flask,o,r,5,main,v1,,docs/openapi.json\n")
    main(["openapi", "drift", str(table), "--specs", str(tmp_path / "specs"), "--truth", str(tmp_path / "truth"), "--output", str(tmp_path / "d")], spark)
    row = csv_text(spark, str(tmp_path / "d")).first()
    assert (row.implemented_endpoints, row.documented_endpoints, row.precision, row.recall) == ("1", "2", "0.5", "1.0")
    main(["openapi", "list-paths", str(table), "--specs", str(tmp_path / "specs"), "--output", str(tmp_path / "l")], spark)
    assert csv_text(spark, str(tmp_path / "l")).count() == 2


def test_search_stats_and_hashes(spark, tmp_path, capsys):
    (tmp_path / "p.json").write_text(json.dumps({"items": [{"id": 1, "owner": {"login": "a"}, "name": "b", "stargazers_count": 2000, "language": "Go"}, {"id": 2, "owner": {"login": "a"}, "name": "c", "stargazers_count": 3000, "language": None}]}))
    main(["github", "search", str(tmp_path / "p.json"), "--output", str(tmp_path / "ledger"), "--language", "go"], spark)
    assert [r.id for r in spark.read.json(str(tmp_path / "ledger")).collect()] == [1]
    code = tmp_path / "clones/o/r/src"
    code.mkdir(parents=True)
    (code / "a.go").write_text("x\ny\n")
    (code / "b.txt").write_text("x\n")
    main(["openapi", "stats", str(tmp_path / "clones"), "--output", str(tmp_path / "s")], spark)
    assert csv_text(spark, str(tmp_path / "s")).first().lines == "2"
    main(["sbom", "hashes", str(tmp_path / "clones")], spark)
    assert "folder" in capsys.readouterr().out


def test_select_steps_and_classify(spark, tmp_path):
    table = tmp_path / "c.csv"
    table.write_text("framework,owner,repo,stars,latest_release,commit_sha\nflask,o,a,5,v1,s\nflask,o,b,9,,\nflask,o,c,1,v1,s\ngin,o,a,5,v1,s\n")
    main(["openapi", "select", str(table), "--top", "2", "--output", str(tmp_path / "s")], spark)
    assert sorted((r.framework, r.repo, r.version) for r in csv_text(spark, str(tmp_path / "s")).collect()) == [("flask", "a", "v1/s"), ("flask", "b", "HEAD/HEAD")]
    there = tmp_path / "clones/o/a/v1/s"
    there.mkdir(parents=True)
    (there / "x.go").write_text("x")
    main(["openapi", "select", str(table), "--top", "2", "--clones", str(tmp_path / "clones"), "--output", str(tmp_path / "t")], spark)
    assert [r.repo for r in csv_text(spark, str(tmp_path / "t")).collect()] == ["b"]
    dates = tmp_path / "d.csv"
    dates.write_text("owner,repo,date,n\no,a,2024-02-01,2\no,a,2024-01-01,1\no,b,2024-01-01,1\n")
    main(["openapi", "steps", str(dates), "--output", str(tmp_path / "p")], spark)
    assert sorted((r.repo, r.step, r.n) for r in csv_text(spark, str(tmp_path / "p")).collect()) == [("a", "1", "1"), ("a", "2", "2")]
    said = tmp_path / "said.jsonl"
    said.write_text(json.dumps({"id": 1, "repo_name": "o/web", "stars": 3, "category": "Web Framework", "tags": ["x"]}) + "\n")
    main(["--warehouse", str(tmp_path / "none"), "github", "classify", str(said), "--output", str(tmp_path / "f")], spark)
    row = csv_text(spark, str(tmp_path / "f")).first()
    assert (row.owner, row.repo, row.category, row.is_web_framework, row.framework) == ("o", "web", "Web Framework", "True", "web")
