import json

from conftest import rows
from pyspark.sql import functions as F

from billow.plans.classify import FLAT, adapted, flat
from billow.plans.openapi import plotted
from billow.sources import checks, files


def test_adapted(spark):
    df = spark.createDataFrame([(None, "me/one", None), ("you", None, "two"), (None, None, "three")], "owner string, repo_name string, repo string")
    assert rows(adapted(df).select("owner", "name")) == [("me", "one"), ("unknown", "three"), ("you", "two")]


def test_flat(spark):
    schema = "id long, owner string, repo string, stars long, language string, topics array<string>, description string, default_branch string, latest_release string, category string, tags array<string>, description_zh string, description_en string, reasoning string, analyzed_at string"
    df = spark.createDataFrame([(1, "o", "r", 1, None, ["x", "y"], None, "main", None, "Web Framework", ["t"], "z", "e", "", ""), (2, "o", "s", 1, "go", None, "d", "main", "v", "Web Application", list("abcdef"), "z", "e", "", ""), (3, "o", "t", 1, "go", None, "d", "main", "v", "nonsense", ["a"], "z", "e", "", "")], schema)
    frameworks = spark.createDataFrame([(2, "gin", "1", 1), (2, "echo", "2", 0)], "repository_id long, framework string, version string, priority int")
    out = {r.id: r for r in flat(df, frameworks).collect()}
    assert flat(df).columns == FLAT
    assert (out[1].framework, out[1].topics, out[1].tags, out[1].is_web_framework) == ("r", "x, y", "", True)
    assert (out[2].framework, out[2].framework_version, out[2].tags) == ("echo", "2", "a, b, c, d, e")
    assert out[3].category == "Other"


def test_files(spark, tmp_path):
    good, bad = tmp_path / "l.jsonl", tmp_path / "m.jsonl"
    good.write_text(json.dumps(dict.fromkeys(checks.LIST_FIELDS, 1)) + "\n")
    bad.write_text('{"id": 1, "owner": "o"}\n')
    assert checks.list_problems(spark, str(good)) == []
    assert "no field name" in checks.list_problems(spark, str(bad))
    assert checks.list_problems(spark, str(tmp_path / "none")) == ["no such file"]
    folder = tmp_path / "s/go/o/r"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"artifacts": []}')
    (folder / "b.json").write_text('{"x": []}')
    (folder / "c.json").write_text("nothing")
    (tmp_path / "s/loose.json").write_text("{}")
    assert checks.sbom_problems(spark, str(tmp_path / "s")).count() == 3
    assert [r.path.rsplit("/", 1)[-1] for r in checks.layout_problems(files.folder_files(spark, str(tmp_path / "s")), str(tmp_path / "s")).collect()] == ["loose.json"]


def test_observed_and_plotted(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "g string, t int")
    counted, watch = checks.observed(df, "counts", total=F.count("*"), late=F.count_if(F.col("t") > 1))
    counted.collect()
    assert watch.get == {"total": 3, "late": 1}
    assert rows(plotted(df, ["g"], "t")) == [("a", 1, 1), ("a", 2, 2)]
