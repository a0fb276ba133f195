"""python -m billow: the stages that read files and tables. Collection from the network is left to other tools."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billow import dims
from billow.functions.tokens import bpe_count
from billow.plans import classify, collect, openapi
from billow.plans.export import projects
from billow.plans.warehouse import Warehouse, adhoc
from billow.session import session
from billow.sinks.tables import append_ledger, write_csv
from billow.sources import files


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Warehouse(read("repositories"), read("artifacts"), read("releases"), dims.framework_packages(spark))


def show(df: DataFrame, rows: int = 100) -> None:
    df.show(rows, truncate=60)


def db_index(spark: SparkSession, args: argparse.Namespace) -> None:
    """Ledgers with their SBOM files become rows of the three tables."""
    now = F.current_timestamp()
    raw = files.json_lines(spark, args.input)
    rows = files.ledger(raw)
    if args.language:
        rows = rows.filter(F.lower("language") == args.language.lower())
    if args.limit:
        rows = rows.orderBy("id").limit(args.limit)
    out = {"repositories": files.repository_rows(rows, now), "releases": files.release_rows(rows, now)}
    if args.sboms:
        target = rows.select(F.col("sbom_path").alias("sbom_file"), "id", F.col("download_target.ref").alias("sbom_ref"), F.col("download_target.commit_sha").alias("sbom_commit_sha"))
        out["artifacts"] = files.artifact_rows(files.sboms(spark, args.sboms), target.filter("sbom_file <> ''"), now)
    for name, df in out.items():
        df.write.mode("append").parquet(f"{args.warehouse}/{name}")
    show(files.failed_lines(raw))


def db_status(spark: SparkSession, args: argparse.Namespace) -> None:
    house = warehouse(spark, args.warehouse)
    for df in (house.stats(), house.languages(), house.framework_stats().orderBy("language", "framework")):
        show(df)


def db_query(spark: SparkSession, args: argparse.Namespace) -> None:
    """Names like the component, then what depends on the first of them (or on the one given)."""
    house = warehouse(spark, args.warehouse)
    found = house.candidates(args.component, args.language, max(args.limit, 20))
    show(found)
    name = args.library or next((r["name"] for r in found.limit(1).collect()), None)
    if name:
        show(house.dependent_count(name, args.language))
        show(house.dependents(name, args.language, args.limit))


def db_export(spark: SparkSession, args: argparse.Namespace) -> None:
    write_csv(projects(warehouse(spark, args.warehouse), args.web_only), args.output)


def db_sql(spark: SparkSession, args: argparse.Namespace) -> None:
    warehouse(spark, args.warehouse).register(spark)
    show(adhoc(spark, args.text))


def openapi_candidates(spark: SparkSession, args: argparse.Namespace) -> None:
    trees = None
    if args.trees:
        trees = files.trees(spark, args.trees).withColumn("position", F.monotonically_increasing_id())
    house = warehouse(spark, args.warehouse)
    found = openapi.candidates(house, trees, dims.commands(spark)).cache()
    write_csv(found, args.output)
    show(openapi.candidate_stats(found, house.framework_stats().groupBy("framework").agg(F.sum("repositories").alias("total"))))


def specs_of(spark: SparkSession, folder: str) -> DataFrame:
    """owner, repo, tag, path, content of the API descriptions under <folder>/<owner>/<repo>/<tag>/."""
    rows = files.folder_files(spark, folder)
    parts = F.split(F.substring_index("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/")
    keyed = rows.select(parts[0].alias("owner"), parts[1].alias("repo"), parts[2].alias("tag"), F.array_join(F.slice(parts, 4, F.size(parts)), "/").alias("path"), F.col("content").cast("string").alias("content"))
    return openapi.description_files(keyed)


def openapi_drift(spark: SparkSession, args: argparse.Namespace) -> None:
    keys = ["owner", "repo", "tag"]
    rows = files.csv_text(spark, args.input).withColumn("tag", F.coalesce(F.nullif("latest_release", F.lit("")), F.nullif("commit_sha", F.lit("")), "default_branch"))
    found = openapi.spec_endpoints(files.yaml_to_json(specs_of(spark, args.specs), keys), keys)
    write_csv(openapi.drift(rows, files.truth_files(spark, args.truth), found), args.output)


def openapi_list_paths(spark: SparkSession, args: argparse.Namespace) -> None:
    keys = ["owner", "repo", "tag"]
    rows = files.csv_text(spark, args.input).withColumn("tag", F.coalesce(F.nullif("latest_release", F.lit("")), F.nullif("commit_sha", F.lit("")), "default_branch"))
    found = openapi.spec_endpoints(files.yaml_to_json(specs_of(spark, args.specs), keys), keys)
    joined = rows.join(found, keys).withColumn("stars", F.expr("try_cast(stars AS bigint)")).withColumn("position", F.lit(0))
    write_csv(openapi.list_paths(joined), args.output)


def openapi_stats(spark: SparkSession, args: argparse.Namespace) -> None:
    """Lines and tokens of the sources of cloned repositories. --input: a table of projects (owner, repo, language), by
    default the ones of the warehouse."""
    root = args.clones.rstrip("/")
    rows = files.folder_files(spark, root)
    listed = files.csv_text(spark, args.input) if args.input else projects(warehouse(spark, args.warehouse)) if files.exists(spark, f"{args.warehouse}/repositories") else None
    parts = F.split(F.substring_index("path", root.rsplit("/", 1)[-1] + "/", -1), "/")
    keyed = rows.select(parts[0].alias("owner"), parts[1].alias("repo"), F.array_join(F.slice(parts, 3, F.size(parts)), "/").alias("path"), "length", F.col("content").cast("string").alias("text"))
    if listed is None:
        sources = keyed.withColumn("language", F.lit(""))
    else:
        sources = keyed.join(listed.select(F.lower("owner").alias("o"), F.lower("repo").alias("r"), "language").dropDuplicates(["o", "r"]), [F.lower("owner") == F.col("o"), F.lower("repo") == F.col("r")])
    counts = (lambda text: bpe_count(spark, text)) if args.bpe else openapi.token_count
    write_csv(openapi.source_stats(sources, ["owner", "repo", "language"], size="length", tokens=counts), args.output)


def openapi_select(spark: SparkSession, args: argparse.Namespace) -> None:
    """Which candidates to clone: the first of each framework, each repository once, without versions under --clones."""
    rows, present = files.csv_text(spark, args.input), None
    if args.clones and not args.force and files.exists(spark, args.clones):
        parts = F.split(F.substring_index("path", args.clones.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/")
        found = files.folder_files(spark, args.clones).select(parts[0].alias("owner"), parts[1].alias("repo"), F.concat_ws("/", parts[2], parts[3]).alias("version"))
        present = found.distinct()
    write_csv(openapi.selected(rows, args.top, present), args.output)


def openapi_steps(spark: SparkSession, args: argparse.Namespace) -> None:
    """What a chart of drift over time needs: the rows of projects with two or more dates, numbered by date."""
    write_csv(openapi.plotted(files.csv_text(spark, args.input), ["owner", "repo"], "date"), args.output)


def github_classify(spark: SparkSession, args: argparse.Namespace) -> None:
    """Saved answers of a classifier (JSON lines with the fields of a record) as flat records, with the frameworks that
    packages of the warehouse show."""
    kinds = "id bigint, owner string, repo string, name string, repo_name string, stars bigint, language string, topics array<string>, description string, default_branch string, latest_release string, category string, tags array<string>, description_zh string, description_en string, reasoning string, analyzed_at string"
    said = classify.adapted(spark.read.schema(kinds).json(args.input))
    rows = said.withColumn("repo", F.coalesce("repo", "name"))
    found = None
    if files.exists(spark, f"{args.warehouse}/artifacts"):
        house = warehouse(spark, args.warehouse)
        order = house.core_packages().groupBy("framework").agg(F.min("priority").alias("priority"))
        found = house.repository_frameworks().join(order, "framework")
    write_csv(classify.flat(rows, found), args.output)


def sbom_hashes(spark: SparkSession, args: argparse.Namespace) -> None:
    """The hash of each folder of manifests, by which a finished SBOM is found again."""
    rows = files.folder_files(spark, args.input).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    named = rows.select("folder", F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("content").cast("string").alias("content"))
    show(collect.content_hash(named, ["folder"], "name", "content"))


def github_search(spark: SparkSession, args: argparse.Namespace) -> None:
    """Saved search pages into a ledger, each repository once."""
    from billow.sources.search import SearchSource

    spark.dataSource.register(SearchSource)
    rows = spark.read.format("repository_search").option("path", args.input).option("least", args.min_stars).load()
    if args.language:
        rows = rows.filter(F.lower(F.coalesce("language", F.lit(""))) == args.language.lower())
    append_ledger(rows, args.output, "id", [F.desc("stars"), F.asc("owner"), F.asc("repo")], args.force)


COMMANDS = {
    ("db", "index"): (db_index, ["input", "--sboms", "--language", "--limit:int"]),
    ("db", "status"): (db_status, []),
    ("db", "query"): (db_query, ["component", "--limit:int=10", "--language", "--library"]),
    ("db", "export"): (db_export, ["--output=projects", "--web-only:flag"]),
    ("db", "sql"): (db_sql, ["text"]),
    ("openapi", "candidates"): (openapi_candidates, ["--output=candidates", "--trees"]),
    ("openapi", "drift"): (openapi_drift, ["input", "--specs=specs", "--truth=truth", "--output=drift"]),
    ("openapi", "list-paths"): (openapi_list_paths, ["input", "--specs=specs", "--output=paths"]),
    ("openapi", "stats"): (openapi_stats, ["clones", "--input", "--output=stats", "--bpe:flag"]),
    ("openapi", "select"): (openapi_select, ["input", "--top:int=0", "--clones", "--force:flag", "--output=selected"]),
    ("openapi", "steps"): (openapi_steps, ["input", "--output=steps"]),
    ("github", "classify"): (github_classify, ["input", "--output=classified"]),
    ("sbom", "hashes"): (sbom_hashes, ["input"]),
    ("github", "search"): (github_search, ["input", "--output=search", "--language", "--min-stars:int=1000", "--force:flag"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="billow", description=__doc__)
    top.add_argument("--warehouse", default="warehouse", help="folder of the three tables")
    groups = top.add_subparsers(required=True)
    made: dict[str, argparse._SubParsersAction] = {}
    for (group, name), (run, options) in COMMANDS.items():
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(required=True)
        command = made[group].add_parser(name, help=run.__doc__)
        command.set_defaults(run=run)
        for option in options:
            spec, _, default = option.partition("=")
            flag, _, kind = spec.partition(":")
            if kind == "flag":
                command.add_argument(flag, action="store_true")
            else:
                command.add_argument(flag, **{"type": int if kind == "int" else str} | ({"default": (int(default) if kind == "int" else default) if default else None} if flag.startswith("-") else {}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    args.run(spark or session(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
