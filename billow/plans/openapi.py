"""API descriptions: candidates, files, endpoints, drift between code and description, sizes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billow.dims import EXTENSIONS, HEAVY_DIRECTORIES, HEAVY_EXTENSIONS, IGNORED_DIRECTORIES, IGNORED_PARTS, LANGUAGES, METHODS, OPENAPI_FILES
from billow.functions.scalars import basename, blob_url, depth, filled, lines_of_code, normalize_path, percent, ref_of, tree_url, version_path
from billow.operators.rank import best_value, keep_first, top_per_group
from billow.operators.sets import agreement
from billow.plans.warehouse import Warehouse
from billow.schemas import CANDIDATES, DRIFT, PATHS


def directories(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def is_description(path: Column) -> Column:
    """Is a path named like an API description, outside directories of tests, examples and dependencies?"""
    above = directories(path)
    named = basename(F.lower(path)).isin(OPENAPI_FILES)
    hidden = F.arrays_overlap(above, F.array(*map(F.lit, IGNORED_DIRECTORIES)))
    partly = F.exists(above, lambda d: reduce(lambda a, b: a | b, [F.contains(d, F.lit(x)) for x in IGNORED_PARTS]))
    return named & ~hidden & ~partly


def description_files(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(is_description(F.col(path)))


def best_file(files: DataFrame, group: list[str], path: str = "path", position: str = "position") -> DataFrame:
    """group, path: of each group's files the one that says openapi or swagger, then the least deep, then the shortest,
    then the first."""
    name = F.lower(basename(F.col(path)))
    said = F.when(F.contains(name, F.lit("openapi")) | F.contains(name, F.lit("swagger")), 0).otherwise(1)
    return best_value(files, group, F.col(path), [said, depth(F.col(path)), F.length(path), F.col(position)], path)


def best_spec(files: DataFrame, group: list[str], path: str = "path", size: str = "length", position: str = "position") -> DataFrame:
    """group, path: of each group's files a JSON file, then the largest, then the first."""
    return best_value(files, group, F.col(path), [F.when(F.lower(path).endswith(".json"), 0).otherwise(1), -F.col(size), F.col(position)], path)


def candidates(warehouse: Warehouse, files: DataFrame | None = None, commands: DataFrame | None = None, base: str = "https://github.com/") -> DataFrame:
    """Repositories that use a framework and have an API description or a package that makes one; columns CANDIDATES.

    files(language, owner, repo, ref, sha, path, position): file trees, each of one commit; its language, owner,
    repository, ref (the release, else the branch) and commit are compared without case, so trees of two commits of one
    ref are not mixed. All frameworks are one plan: artifacts meet the small package dimension where they are read, then
    are aggregated by repository and framework, so no row is multiplied by its siblings. A repository with an excluded package of a framework is none of its candidates.
    """
    marks = warehouse.packages.select("language", "framework", F.col("package_name").alias("name"), "usage", "priority").distinct()
    single = marks.groupBy("framework", "name", "usage").agg(F.min_by("language", F.struct("priority", "language")).alias("language"))
    hits = warehouse.tagged(single, "repository_id", "version")
    by = hits.groupBy("repository_id", "framework").agg(
        F.max(F.when(F.col("usage") == "core", F.col("version"))).alias("framework_version"),
        F.count_if(F.col("usage") == "core").alias("core"),
        F.count_if(F.col("usage") == "excluded").alias("excluded"),
        F.array_sort(F.collect_set(F.when(F.col("usage") == "openapi", F.lower("name")))).alias("deps"),
        F.max("language").alias("framework_language"),
    )
    rows = warehouse.final("repositories", "id", "language", "owner", "repo", "stars", "default_branch", "latest_release_tag", "sbom_commit_sha")
    named = rows.select("id", F.lower("language").alias("language"), F.lower("owner").alias("owner"), F.lower("repo").alias("repo"), "stars", F.lower("default_branch").alias("default_branch"), F.lower("latest_release_tag").alias("latest_release"), F.lower("sbom_commit_sha").alias("commit_sha"))
    joined = by.filter("core > 0 AND excluded = 0").join(named, F.col("repository_id") == F.col("id")).withColumn("language", filled(F.col("language"), F.col("framework_language")))
    if files is not None:
        of_commit = [F.lower(c).alias(f"f_{c}") for c in ("language", "owner", "repo", "ref", "sha")]
        best = best_file(description_files(files).select(*of_commit, "path", "position"), ["f_language", "f_owner", "f_repo", "f_ref", "f_sha"])
        same = [F.col(a) == F.col(b) for a, b in (("language", "f_language"), ("owner", "f_owner"), ("repo", "f_repo"), ("commit_sha", "f_sha"))]
        joined = joined.join(best, [*same, ref_of(F.col("latest_release"), F.col("default_branch")) == F.col("f_ref")], "left")
    else:
        joined = joined.withColumn("path", F.lit(None).cast("string"))
    out = joined.withColumn("openapi_file", F.coalesce("path", F.lit(""))).filter((F.col("openapi_file") != "") | (F.size("deps") > 0))
    if commands is not None:
        # Commands by framework are a map on one row, so the first dependency that has one is found without a join on elements.
        by_framework = commands.groupBy(F.col("framework").alias("cf")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.lower("dependency").alias("d"), F.col("command").alias("c"))))).alias("cmds"))
        out = out.join(by_framework, F.col("framework") == F.col("cf"), "left")
        known = F.filter("deps", lambda d: F.array_contains(F.map_keys("cmds"), d))
        command = F.coalesce(F.element_at("cmds", F.try_element_at(known, F.lit(1))), F.try_element_at("cmds", F.col("framework")), F.lit(""))
        out = out.withColumn("generation_command", command)
    else:
        out = out.withColumn("generation_command", F.lit(""))
    url = F.concat(F.lit(base), "owner", F.lit("/"), "repo")
    return out.select(
        "language", "framework", F.lower(F.coalesce("framework_version", F.lit(""))).alias("framework_version"), "owner", "repo", "stars", "default_branch", "latest_release",
        "commit_sha", tree_url(url, F.col("latest_release"), F.col("commit_sha")).alias("url"), "openapi_file",
        blob_url(url, filled(F.col("commit_sha"), ref_of(F.col("latest_release"), F.col("default_branch"))), F.col("openapi_file")).alias("openapi_url"),
        F.array_join("deps", ";").alias("matched_dependencies"), (F.col("openapi_file") != "").alias("has_openapi_file"), (F.size("deps") > 0).alias("has_openapi_deps"),
        "generation_command",
    ).select(*CANDIDATES).orderBy("language", "framework", F.desc("stars"), "owner", "repo")


def candidate_stats(found: DataFrame, totals: DataFrame) -> DataFrame:
    """framework, total, matched, both, file_only, deps_only, percentage, with a last row TOTAL over all frameworks.

    totals(framework, total): repositories that use each framework, matched or not.
    """
    file, deps = F.col("has_openapi_file"), F.col("has_openapi_deps")
    counts = found.groupBy("framework").agg(F.count("*").alias("matched"), F.count_if(file & deps).alias("both"), F.count_if(file & ~deps).alias("file_only"), F.count_if(deps & ~file).alias("deps_only"))
    rows = totals.join(counts, "framework", "left").na.fill(0)
    sums = rows.rollup("framework").agg(*[F.sum(c).alias(c) for c in ("total", "matched", "both", "file_only", "deps_only")])
    return sums.select(F.coalesce("framework", F.lit("TOTAL")).alias("framework"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums.columns[1:]], percent(F.col("matched"), F.col("total")).alias("percentage"))


def distinct_projects(found: DataFrame) -> DataFrame:
    """projects: how many different repositories the candidates of all frameworks are."""
    return found.agg(F.count_distinct("owner", "repo").alias("projects"))


def selected(rows: DataFrame, top: int = 0, present: DataFrame | None = None) -> DataFrame:
    """The projects to fetch, of rows(framework, owner, repo, stars, latest_release, commit_sha, ...): of each framework
    the `top` with most stars (0: all), each (owner, repo) once, by its first framework, without those of which
    present(owner, repo, version) has the version already. Ties are broken by owner and repo. Adds version."""
    stars = F.coalesce(F.expr("try_cast(stars AS bigint)"), F.lit(0))
    if top > 0:
        rows = top_per_group(rows, ["framework"], [stars.desc(), F.asc("owner"), F.asc("repo")], top)
    first = keep_first(rows, ["owner", "repo"], [F.asc("framework"), stars.desc(), F.asc("latest_release"), F.asc("commit_sha")])
    out = first.withColumn("version", version_path(F.col("latest_release"), F.col("commit_sha")))
    return out if present is None else out.join(present.select("owner", "repo", "version"), ["owner", "repo", "version"], "left_anti")


def spec_endpoints(specs: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, method, path: the endpoints of API descriptions in JSON text, made equal to compare; distinct.

    A text that is no JSON, or has no paths, gives none.
    """
    paths = F.from_json(F.get_json_object(content, "$.paths"), "map<string,string>")
    rows = specs.select(*keys, F.explode(paths).alias("raw", "methods"))
    each = rows.select(*keys, F.col("raw"), F.explode(F.map_keys(F.from_json("methods", "map<string,string>"))).alias("method"))
    return each.filter(F.lower("method").isin(METHODS)).select(*keys, F.upper("method").alias("method"), normalize_path(F.col("raw")).alias("path")).distinct()


def drift(projects: DataFrame, truth: DataFrame, specs: DataFrame) -> DataFrame:
    """Columns DRIFT: how the endpoints in code (truth) and in descriptions (specs) agree, one row a project.

    All are keyed by owner, repo, tag. Endpoints are normalised and made distinct here. Without endpoints in code all
    measures are 0, the number of documented ones stays.
    """
    keys, item = ["owner", "repo", "tag"], ["method", "path"]
    clean = lambda df: df.select(*keys, F.upper("method").alias("method"), normalize_path(F.col("path")).alias("path"))
    measured = agreement(clean(specs), clean(truth), keys, item)
    joined = projects.join(measured, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return joined.select(
        "language", "framework", "owner", "repo", "stars", "tag", zero("n_truth").alias("implemented_endpoints"), zero("n_found").alias("documented_endpoints"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(a) for c, a in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"))], "openapi_file",
    ).select(*DRIFT)


def list_paths(endpoints: DataFrame) -> DataFrame:
    """Columns PATHS: each (method, path) of a project once, in the order of a report. endpoints has the columns PATHS
    and position, the order of reading."""
    first = keep_first(endpoints, ["owner", "repo", "tag", "method", "path"], [F.asc("position")])
    return first.select(*PATHS).orderBy("language", "framework", F.desc("stars"), "owner", "repo", "tag", "path", "method")


def token_count(text: Column) -> Column:
    """An estimate of a text's tokens from words, numbers, signs and breaks, without a vocabulary."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z]{1,7}|[0-9]{1,3}|[^\sA-Za-z0-9]|\s*[\r\n]+"), F.lit(0))).cast("bigint")


def is_source(path: Column, language: Column) -> Column:
    """Does a file name end like a source of the language, or of any common one where the language is not known?"""
    suffix = F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)
    named = F.lower(language)
    out = F.when(F.coalesce(named.isin(list(LANGUAGES)), F.lit(False)), F.lit(False)).otherwise(suffix.isin(EXTENSIONS))
    for name, (_, _, ends) in LANGUAGES.items():
        out = F.when(named == name, suffix.isin(ends)).otherwise(out)
    return out


def source_stats(files: DataFrame, group: list[str], path: str = "path", text: str = "text", language: str = "language", size: str | None = None, most: int = 1 << 20, tokens: Callable[[Column], Column] = token_count) -> DataFrame:
    """group, lines, tokens, files: of the files outside ignored directories whose names end like sources of their
    repository's language (see `is_source`); files over `most` bytes count as 0 lines and tokens.

    size: the column with the bytes of a file; by default those of its text. tokens: how tokens are counted, by default
    an estimate; `billow.functions.tokens.bpe_count` counts them by a vocabulary.
    """
    small = (F.octet_length(F.coalesce(text, F.lit(""))) if size is None else F.col(size)) <= most
    ignored = F.arrays_overlap(directories(F.col(path)), F.array(*map(F.lit, IGNORED_DIRECTORIES)))
    read = F.when(small, F.col(text))
    rows = files.filter(~ignored & is_source(F.col(path), F.col(language))).select(*group, lines_of_code(read).alias("lines"), tokens(read).alias("tokens"))
    return rows.groupBy(*group).agg(F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"), F.count("*").alias("files"))


def context_fit(stats: DataFrame, windows: DataFrame, models: list[str]) -> DataFrame:
    """stats with one boolean column a model: do its tokens fit the window? windows(model, tokens) has a row a model and
    becomes one map on one row."""
    table = windows.agg(F.map_from_entries(F.collect_list(F.struct("model", F.col("tokens").alias("size")))).alias("__sizes"))
    return stats.join(F.broadcast(table)).select(*stats.columns, *[(F.col("tokens") <= F.try_element_at("__sizes", F.lit(m))).alias(m) for m in models])


def plotted(rows: DataFrame, group: list[str], at: str, least: int = 2) -> DataFrame:
    """The rows of groups with at least `least` of them, with step, their number in order of time: what a chart needs."""
    by = Window.partitionBy(*group)
    return rows.withColumn("__n", F.count("*").over(by)).filter(F.col("__n") >= least).withColumn("step", F.row_number().over(by.orderBy(at))).drop("__n")


def tree_sizes(files: DataFrame, group: list[str], path: str = "path", size: str = "length") -> DataFrame:
    """group, total, kept, saved_percent: bytes of all files, of those left without heavy directories and extensions,
    and what leaving them out saves."""
    heavy = F.arrays_overlap(directories(F.col(path)), F.array(*map(F.lit, HEAVY_DIRECTORIES))) | F.lower(path).rlike("(" + "|".join(x.replace(".", "\\.") for x in HEAVY_EXTENSIONS) + ")$")
    sums = files.groupBy(*group).agg(F.sum(size).alias("total"), F.coalesce(F.sum(F.when(~heavy, F.col(size))), F.lit(0)).alias("kept"))
    return sums.withColumn("saved_percent", F.round(F.coalesce((1 - F.try_divide(F.col("kept").cast("double"), F.col("total").cast("double"))) * 100, F.lit(0.0)), 1))
