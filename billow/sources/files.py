"""Ledgers, SBOM documents, CSV and text files, trees, refs and API descriptions as DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billow.functions.scalars import filled, iso_time, license_names, owner_name, short_sha, strip, time_or_default
from billow.schemas import ENDPOINTS, LEDGER, RELEASE_PAGE, SBOM

BAD = "_corrupt_record"
#: What tells a tree from another; each is a level of its folder. An empty value has a name of its own there, as Spark gives it.
TREE, NO_VALUE = ["language", "owner", "repo", "ref", "sha"], b"__HIVE_DEFAULT_PARTITION__"
#: Rows and bytes of a batch of lines.
BATCH_ROWS, BATCH_BYTES = 8192, 1 << 24


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder, or any match of a pattern?"""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    matches = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    return matches is not None and len(matches) > 0


def json_lines(spark: SparkSession, path: str, schema: T.StructType = LEDGER) -> DataFrame:
    """One row a line, with the text of a line that is no object in _corrupt_record. Blank lines give no row; a missing
    file gives no rows; keys outside the schema are left out."""
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def ledger(rows: DataFrame) -> DataFrame:
    """Valid lines of a ledger under one name for each field; aliases and missing values resolved."""
    ok = rows.filter(F.col(BAD).isNull()) if BAD in rows.columns else rows
    aliases = {"repo": ("repo", "name"), "stars": ("stars", "stargazers_count"), "url": ("url", "html_url"), "is_archived": ("is_archived", "archived"), "is_fork": ("is_fork", "fork"), "disk_usage": ("disk_usage", "size"), "fork_count": ("fork_count", "forks_count")}
    drop = {"name", "stargazers_count", "html_url", "archived", "fork", "size", "forks_count", "license", BAD}
    license_of = lambda field: F.get_json_object("license", f"$.{field}")
    values: dict[str, Column] = {c: F.col(c) for c in ok.columns if c not in drop}
    values |= {name: F.coalesce(*map(F.col, names)) for name, names in aliases.items()}
    values |= {"owner": owner_name(F.col("owner")), "default_branch": filled(F.col("default_branch"), F.lit("main"))}
    values |= {"license_spdx_id": filled(F.col("license_spdx_id"), license_of("spdx_id")), "license_name": filled(F.col("license_name"), license_of("name"))}
    return ok.select([v.alias(k) for k, v in values.items()])


def failed_lines(rows: DataFrame) -> DataFrame:
    """lines, failed, keyed: how many lines there are, how many are no object, how many have the first field (the key)."""
    return rows.agg(F.count("*").alias("lines"), F.count(BAD).alias("failed"), F.count(rows.columns[0]).alias("keyed"))


def repository_rows(rows: DataFrame, loaded: Column) -> DataFrame:
    """Warehouse rows of repositories from a ledger; `loaded` becomes updated_at."""
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    flag = lambda c: F.coalesce(c, F.lit(False))
    date = lambda c: time_or_default(iso_time(c))
    target, latest = F.col("download_target"), F.col("latest_stable_release")
    return rows.select(
        "id", text(F.col("owner")).alias("owner"), text(F.col("repo")).alias("repo"), text(F.col("url")).alias("url"), number(F.col("stars")).alias("stars"), text(F.col("description")).alias("description"),
        date(F.col("created_at")).alias("created_at"), text(F.col("language")).alias("language"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "default_branch",
        text(target["ref"]).alias("sbom_ref"), text(target["ref_type"]).alias("sbom_ref_type"), text(target["commit_sha"]).alias("sbom_commit_sha"),
        filled(target["commit_sha_short"], short_sha(target["commit_sha"])).alias("sbom_commit_sha_short"), flag(F.col("has_releases")).alias("has_releases"), text(latest["tag_name"]).alias("latest_release_tag"),
        date(latest["published_at"]).alias("latest_release_published_at"), number(F.col("total_releases")).alias("total_releases"), loaded.alias("updated_at"), date(F.col("pushed_at")).alias("pushed_at"),
        *[flag(F.col(c)).alias(c) for c in ("is_archived", "is_fork", "is_template", "is_mirror")], *[number(F.col(c)).alias(c) for c in ("disk_usage", "fork_count", "watchers_count")],
        "license_spdx_id", "license_name", F.lit("{}").alias("languages"), F.lit(None).cast("bigint").alias("vulnerability_alerts_count"),
    )


def release_rows(rows: DataFrame, loaded: Column) -> DataFrame:
    """Warehouse rows of releases from a ledger's all_releases; either spelling of the flags counts."""
    r = F.col("r")
    return rows.select(F.col("id").alias("repository_id"), F.explode("all_releases").alias("r")).select(
        "repository_id", F.coalesce(r["id"], F.lit(0).cast("bigint")).alias("release_id"), F.coalesce(r["tag_name"], F.lit("")).alias("tag_name"), F.coalesce(r["name"], F.lit("")).alias("name"),
        F.coalesce(r["is_prerelease"], r["prerelease"], F.lit(False)).alias("is_prerelease"), F.coalesce(r["is_draft"], r["draft"], F.lit(False)).alias("is_draft"),
        time_or_default(iso_time(r["published_at"])).alias("published_at"), F.coalesce(r["target_commitish"], F.lit("")).alias("target_commitish"), time_or_default(iso_time(r["created_at"])).alias("created_at"),
        F.coalesce(F.to_json(r["assets"]), F.lit("[]")).alias("release_assets"), filled(r["source"], F.lit("github_release")).alias("source"), loaded.alias("updated_at"),
    )


def release_pages(spark: SparkSession, path: str) -> DataFrame:
    """page and one row an element of saved pages of releases, each a JSON array as a hosting service returns it, with the
    columns that `billow.plans.collect.merged_releases` takes, but for repository_id. The last part of a page's folder
    tells whose it is."""
    rows = spark.read.schema(RELEASE_PAGE).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("page", F.element_at(F.split("_metadata.file_path", "/"), -2))
    date = lambda c: iso_time(F.col(c))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(f"is_{c}")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select("page", text("tag_name"), text("name"), flag("prerelease"), flag("draft"), date("published_at").alias("published_at"), date("created_at").alias("created_at"), text("target_commitish"))


def sboms(spark: SparkSession, path: str) -> DataFrame:
    """file and one row an element of `artifacts`, from JSON documents of many lines. A file that is no JSON gives none.
    A local file is named by its plain path, others by their address."""
    full = T.StructType([*SBOM.fields, T.StructField(BAD, T.StringType())])
    if not exists(spark, path):
        rows = spark.createDataFrame([], full).withColumn("file", F.lit(""))
    else:
        rows = spark.read.schema(full).option("multiLine", True).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", BAD).json(path).withColumn("file", F.regexp_replace("_metadata.file_path", "^file:/*", "/"))
    return rows.select("file", F.explode("artifacts").alias("a")).select("file", "a.*")


def artifact_rows(elements: DataFrame, repositories: DataFrame, loaded: Column) -> DataFrame:
    """Warehouse rows of artifacts: SBOM elements with their repository by the file they came from.
    repositories(sbom_file, id, sbom_ref, sbom_commit_sha)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = elements.join(repositories, elements["file"] == repositories["sbom_file"])
    licenses = license_names(F.from_json("licenses", "array<string>"))
    return joined.select(
        repositories["id"].alias("repository_id"), F.coalesce(elements["id"], F.lit("")).alias("artifact_id"), text("name").alias("name"), text("version").alias("version"), text("type").alias("type"), text("purl").alias("purl"),
        text("foundBy").alias("found_by"), licenses.alias("licenses"), text("sbom_ref").alias("sbom_ref"), text("sbom_commit_sha").alias("sbom_commit_sha"), loaded.alias("updated_at"),
    )


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every value a text, blanks as ''."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.na.fill("")


def csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header and a given schema; a blank is null."""
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value: trimmed lines that are not blank."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), strip(F.col("value")).alias("value"))
    return rows.filter("value <> ''")


def trees(spark: SparkSession, root: str) -> DataFrame:
    """language, owner, repo, ref, sha, path, from <language>/<owner>/<repo>/<ref>/<sha>/tree.txt under a folder."""
    rows = text_lines(spark, root.rstrip("/") + "/*/*/*/*/*/tree.txt")
    parts = F.split("file", "/")
    names = ["language", "owner", "repo", "ref", "sha"]
    return rows.select(*[F.url_decode(F.element_at(parts, k - 6)).alias(c) for k, c in enumerate(names)], F.col("value").alias("path"))


def machine_folder(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder that the machines reach by their own file system, all of them alike; else None."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(found).toUri().getPath() if system.getUri().getScheme() == "file" else None


def shown(folder: bytes) -> list[bytes]:
    """Paths in a folder, without those that Spark takes as hidden."""
    with os.scandir(folder) as entries:
        return [e.path for e in entries if e.name[:1] not in (b"_", b".")]


def below(folder: bytes, names: list[str], values: tuple[bytes, ...] = ()) -> Iterator[tuple[bytes, tuple[bytes, ...]]]:
    """Folders <name>=<value> under a folder, a level for each name, with their values after those given."""
    if not names:
        yield folder, values
        return
    begin = names[0].encode() + b"="
    for path in shown(folder):
        name, text = os.path.basename(path), os.path.basename(path)[len(begin) :]
        if not name.startswith(begin):
            raise ValueError(f"{os.fsdecode(path)} is no folder {names[0]}=...")
        value = b"" if text == NO_VALUE else re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text)
        yield from below(path, names[1:], (*values, value))


def tree_table(spark: SparkSession, root: str) -> DataFrame:
    """language, owner, repo, ref, sha, path of what `billow.sinks.tables.write_trees` wrote.

    Trees are many and small. Where the machines reach them by their own file system, owners are listed by one task and the
    trees of each owner are found and read by the others: no list of all of them goes through the driver, and a task does
    not stand for a few files only, as Spark's reader would have it.
    """
    folder = machine_folder(spark, root)
    if folder is None or not os.path.isdir(folder):
        rows = spark.read.schema("value string, " + ", ".join(f"{c} string" for c in TREE)).text(root)
    else:
        owners = spark.createDataFrame([(os.fsencode(folder),)], "folder binary").mapInArrow(_owners, "folder binary, language binary, owner binary")
        lines = owners.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_tree_lines, ", ".join(f"{c} binary" for c in [*TREE, "value"]))
        rows = lines.select(*[F.col(c).cast("string").alias(c) for c in [*TREE, "value"]])
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in TREE], strip(F.col("value")).alias("path")).filter("path <> ''")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names)


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folders of owners under each root."""
    rows: list[tuple] = []
    for batch in batches:
        for root in batch.column(0).to_pylist():
            for folder, values in below(root, TREE[:2]):
                rows.append((folder, *values))
                if len(rows) == BATCH_ROWS:
                    yield _batch(rows, ["folder", *TREE[:2]])
                    rows = []
    if rows:
        yield _batch(rows, ["folder", *TREE[:2]])


def _tree_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of all trees under each folder of an owner."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for owner, *values in zip(*(c.to_pylist() for c in batch.columns)):
            for folder, keys in below(owner, TREE[2:], tuple(values)):
                for path in shown(folder):
                    with open(path, "rb") as file:
                        for part in file:
                            for line in part.splitlines():  # a lone carriage return ends a line too
                                rows.append((*keys, line))
                                size += len(line) + sum(map(len, keys))
                                if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                                    yield _batch(rows, [*TREE, "value"])
                                    rows, size = [], 0
    if rows:
        yield _batch(rows, [*TREE, "value"])


def folder_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, content (bytes) of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "content")


def truth_files(spark: SparkSession, root: str) -> DataFrame:
    """owner, repo, tag, method, path from <owner>/<repo>/<tag>.json, each a JSON array of {method, path}."""
    rows = spark.read.schema(ENDPOINTS).option("multiLine", True).json(root.rstrip("/") + "/*/*/*.json").withColumn("__p", F.split("_metadata.file_path", "/"))
    name = F.url_decode(F.element_at("__p", -1))
    return rows.select(F.url_decode(F.element_at("__p", -3)).alias("owner"), F.url_decode(F.element_at("__p", -2)).alias("repo"), F.left(name, F.length(name) - 5).alias("tag"), "method", "path")


def yaml_to_json(specs: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """specs with YAML texts as JSON; JSON texts stay, a text that is neither becomes null. Spark reads no YAML, so this
    is the one step in Python, batch by batch, and only for texts that do not begin like JSON. It needs the yaml module;
    without it YAML texts become null."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        import json

        try:
            import yaml
        except ImportError:
            return pd.Series([None] * len(texts), dtype=object)

        def one(text: str | None) -> str | None:
            try:
                return json.dumps(yaml.safe_load(text), default=str) if text else None
            except Exception:  # noqa: BLE001 - a text that cannot be read has no endpoints
                return None

        return texts.map(one)

    like_json = F.ltrim(F.col(content)).startswith("{")
    json_rows = specs.filter(like_json).select(*keys, content)
    return json_rows.unionByName(specs.filter(~like_json).select(*keys, convert(content).alias(content)))


def check_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that a DataFrame lacks."""
    return [c for c in required if c not in df.columns]


def seen_and_least(rows: DataFrame) -> DataFrame:
    """ids, least_stars of a ledger: distinct ids and the smallest number of stars, the point to resume from."""
    return rows.agg(F.count_distinct("id").alias("ids"), F.min("stars").alias("least_stars"))
