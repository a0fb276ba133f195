import json

import pytest
from pyspark.sql import functions as F

from billow.functions import scalars as S


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("path", "norm"),
    [("", "/"), (None, "/"), ("/Users/:id/", "/users/{}"), ("users/{userId}/posts/<int:pid>?x=1", "/users/{}/posts/{}"), ("//", "/"), ("/a/ ", "/a"), ("http://h:8080/x", "/http://h{}/x"), ("/", "/")],
)
def test_normalize_path(spark, path, norm):
    assert one(spark, S.normalize_path(F.col("p")), p=path) == norm


def test_licenses(spark):
    items = ["MIT", json.dumps({"value": "", "spdxExpression": "Apache-2.0"}), json.dumps({"name": "X"}), "{}", None, ""]
    assert one(spark, S.license_names(F.col("l")), l=items) == ["MIT", "Apache-2.0", "X"]


def test_owner_refs_and_urls(spark):
    assert one(spark, S.owner_name(F.col("o")), o='{"login": "me", "id": 1}') == "me"
    assert one(spark, S.owner_name(F.col("o")), o="me") == "me"
    assert one(spark, S.ref_name(F.col("r")), r="refs/tags/v1^{}") == "v1"
    assert one(spark, S.tree_url(F.lit("u"), F.lit(""), F.col("s")), s="abc") == "u/tree/abc"
    assert one(spark, S.version_path(F.col("t"), F.lit("abc")), t="  ") == "HEAD/abc"
    assert one(spark, S.masked(F.col("t"), F.lit("key")), t="a key b") == "a ***** b"
    assert one(spark, S.iso_time(F.col("t")), t="soon") is None
    assert one(spark, S.iso_time(F.col("t")), t="2024-06-03T23:37:33Z").day == 3


@pytest.mark.parametrize(("size", "text"), [(0, "0 Bytes"), (1, "1 Byte"), (999, "999 Bytes"), (1500, "1.5 kB"), (2_000_000, "2.0 MB"), (3_200_000_000, "3.2 GB")])
def test_natural_size(spark, size, text):
    assert one(spark, S.natural_size(F.col("n")), n=size) == text


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n\n", "a\x0bb\x0cc\u2028d", None])
def test_lines_as_splitlines(spark, text):
    assert one(spark, S.lines_of_code(F.col("t")), t=text) == len((text or "").splitlines())


def test_small_ones(spark):
    assert one(spark, S.comma_list(F.col("t")), t=" a, b ,,c") == ["a", "b", "c"]
    assert one(spark, S.first_tags(F.lit("Web Application"), F.col("t")), t=list("abcdefg")) == list("abcde")
    assert one(spark, S.first_tags(F.lit("Other"), F.col("t")), t=["a"]) == []
    assert one(spark, S.ratio(F.col("a"), F.lit(0)), a=3) == 0.0
    assert one(spark, S.percent(F.col("a"), F.lit(3)), a=1) == 33.33
    assert one(spark, S.cache_name(F.col("m")), m="a:b") == "a/b"
