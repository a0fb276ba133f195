"""The warehouse: newest rows of three versioned tables, and the queries on them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billow.operators.rank import top_per_group
from billow.schemas import TABLES, normalised
from billow.tables import KEYS, newest


def like_part(text: str) -> str:
    """A pattern that finds `text` anywhere. % and _ in it are wildcards; a backslash stands for itself."""
    return "%" + text.replace("\\", "\\\\") + "%"


class Warehouse:
    """repositories, artifacts, releases: tables with all versions of their rows. packages: language, framework,
    package_name, usage, priority, position, one row a package (a dimension kept by hand, see billow.dims)."""

    def __init__(self, repositories: DataFrame, artifacts: DataFrame, releases: DataFrame | None = None, packages: DataFrame | None = None):
        self.tables = {"repositories": repositories, "artifacts": artifacts, "releases": releases}
        self.packages = packages

    def final(self, table: str, *columns: str, where: Column | None = None) -> DataFrame:
        """The newest row of each key, without nulls (see `normalised`), with these columns or all.

        Columns that are part of the key are the same in all versions, so distinct keys stand for newest rows, which
        needs no sort. Else only the columns asked for, the key and the version are read. where: a condition on columns of
        the key as they are stored, by which the reader of files may skip.
        """
        wanted = list(columns) or TABLES[table].names
        source = self.tables[table]
        if source is None:
            raise ValueError(f"no table {table}")
        if where is not None:
            source = source.filter(where)
        key = KEYS[table]
        if set(wanted) <= set(key):
            return normalised(source, table, key).distinct().select(*wanted)
        names = list(dict.fromkeys([*key, *wanted, "updated_at"]))
        return newest(normalised(source, table, names), key).select(*wanted)

    def uses(self, *columns: str, where: Column | None = None) -> DataFrame:
        """Artifacts with the columns of their repository (prefix r_), for known repositories."""
        mine = [c for c in columns if not c.startswith("r_")]
        theirs = [c.removeprefix("r_") for c in columns if c.startswith("r_")]
        repositories = self.final("repositories", "id", *theirs).select("id", *[F.col(c).alias(f"r_{c}") for c in theirs])
        return self.final("artifacts", *dict.fromkeys(["repository_id", *mine]), where=where).join(repositories, F.col("repository_id") == F.col("id")).select(*columns)

    def tagged(self, marks: DataFrame, *columns: str) -> DataFrame:
        """These columns of all artifact rows with a name in marks(name, ...), with the columns of marks.

        For what does not change with repeated rows, of columns that are part of the key: such need no newest rows. So
        artifacts meet the small dimension where they are read, and nearly none of them is sent.
        """
        assert {*columns, "name"} <= set(KEYS["artifacts"])
        rows = normalised(self.tables["artifacts"], "artifacts", list(dict.fromkeys(["name", *columns])))
        return rows.join(marks, "name")

    def stats(self) -> DataFrame:
        """repositories, artifacts: rows of each, in one row."""
        a = self.final("repositories", "id").agg(F.count("*").alias("repositories"))
        return a.join(F.broadcast(self.final("artifacts", "repository_id").agg(F.count("*").alias("artifacts"))))

    def languages(self) -> DataFrame:
        return self.final("repositories", "language").groupBy("language").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "language")

    def top_dependencies(self, limit: int = 20) -> DataFrame:
        """name, repo_count. Versions do not change which repository has which name, so raw rows are counted."""
        rows = normalised(self.tables["artifacts"], "artifacts", ["name", "repository_id"])
        return rows.distinct().groupBy("name").agg(F.count("repository_id").alias("repo_count")).orderBy(F.desc("repo_count"), "name").limit(limit)

    def types(self) -> DataFrame:
        return self.final("artifacts", "type").groupBy("type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "type")

    def search(self, component: str, limit: int = 10) -> DataFrame:
        found = self.uses("name", "version", "r_owner", "r_repo").filter(F.col("name").ilike(like_part(component)))
        rows = found.select(F.col("r_owner").alias("owner"), F.col("r_repo").alias("repo"), "name", "version")
        return rows.orderBy("owner", "repo", "name", "version").limit(limit)

    def candidates(self, pattern: str, language: str | None = None, limit: int = 20) -> DataFrame:
        """name, cnt (artifact rows), repo_cnt (repositories); the language is compared as it is written."""
        found = self.uses("name", "repository_id", "r_language").filter(F.col("name").ilike(like_part(pattern)))
        if language is not None:
            found = found.filter(F.col("r_language") == language)
        counts = found.groupBy("name").agg(F.count("*").alias("cnt"), F.count_distinct("repository_id").alias("repo_cnt"))
        return counts.orderBy(F.desc("cnt"), "name").limit(limit)

    def of_library(self, library: str | DataFrame, language: str | None, *columns: str) -> DataFrame:
        """Uses of a library by name, or of those in a DataFrame(name)."""
        # The name as it is stored can be looked up in the statistics of files; without null as '' it cannot.
        stored = F.col("name") == library if isinstance(library, str) and library else None
        rows = self.uses(*dict.fromkeys(["name", "r_language", *columns]), where=stored)
        rows = rows.filter(F.col("name") == library) if isinstance(library, str) else rows.join(library.select("name").distinct(), "name", "left_semi")
        return rows if language is None else rows.filter(F.col("r_language") == language)

    def dependent_count(self, library: str | DataFrame, language: str | None = None) -> DataFrame:
        return self.of_library(library, language, "repository_id").agg(F.count("*").alias("dependents"))

    def dependents(self, library: str | DataFrame, language: str | None = None, limit: int = 50) -> DataFrame:
        rows = self.of_library(library, language, "version", "r_owner", "r_repo", "r_stars", "r_url")
        named = rows.select(F.col("r_owner").alias("owner"), F.col("r_repo").alias("repo"), F.col("r_stars").alias("stars"), "version", F.col("r_url").alias("url"))
        return named.orderBy(F.desc("stars"), "owner", "repo", "version", "url").limit(limit)

    def in_language(self, language: str, *columns: str) -> DataFrame:
        return self.final("repositories", *dict.fromkeys(["id", "language", *columns])).filter(F.lower("language") == language.lower())

    def with_packages(self, packages: list[str] | DataFrame) -> DataFrame:
        """repository_id of the artifacts with one of these names (or those of a DataFrame(name)), before any dedupe:
        names are part of the key."""
        source = self.tables["artifacts"]
        if isinstance(packages, DataFrame):
            rows = normalised(source, "artifacts", ["repository_id", "name"])
            return rows.join(packages.select("name").distinct(), "name", "left_semi").select("repository_id")
        if "" not in packages:
            source = source.filter(F.col("name").isin(packages))
        return normalised(source, "artifacts", ["repository_id", "name"]).filter(F.col("name").isin(packages)).select("repository_id")

    def framework_usage(self, language: str, packages: list[str] | DataFrame) -> DataFrame:
        rows = self.in_language(language)
        return rows.join(self.with_packages(packages), rows["id"] == F.col("repository_id"), "left_semi").agg(F.count("*").alias("repositories"))

    def top_projects(self, language: str, packages: list[str] | DataFrame, limit: int = 3) -> DataFrame:
        rows = self.in_language(language, "owner", "repo", "stars", "url")
        found = rows.join(self.with_packages(packages), rows["id"] == F.col("repository_id"), "left_semi").select("owner", "repo", "stars", "url").distinct()
        return found.orderBy(F.desc("stars"), "owner", "repo", "url").limit(limit)

    def core_packages(self) -> DataFrame:
        """The dimension's core packages. It is small by construction; Spark broadcasts it by its measured size."""
        return self.packages.filter("usage = 'core'")

    def repository_frameworks(self, repository_id: int | Column | None = None) -> DataFrame:
        """repository_id, framework, version: what its packages say, for one repository or for all."""
        marks = self.core_packages().select(F.col("package_name").alias("name"), "framework").filter("name <> ''").distinct()
        rows = self.tagged(marks, "repository_id", "version")
        if repository_id is not None:
            rows = rows.filter(F.col("repository_id") == repository_id)
        return rows.select("repository_id", "framework", "version").distinct()

    def framework_stats(self, samples: int = 3) -> DataFrame:
        """language, framework, repositories, samples: how many repositories of the language use the framework, and the
        first of them by stars (owner/repo joined by ';'). Frameworks that none uses stay, with 0.

        All languages and frameworks in one plan: the dimension meets distinct (repository, name) rows once.
        """
        marks = self.core_packages().select("language", "framework", "package_name").distinct()
        pairs = marks.select("language", "framework").distinct()
        names = normalised(self.tables["artifacts"], "artifacts", ["repository_id", "name"])
        tagged = names.join(marks, names["name"] == marks["package_name"]).select("repository_id", "language", "framework").distinct()
        repositories = self.final("repositories", "id", "language", "owner", "repo", "stars").withColumn("l", F.lower("language")).drop("language")
        used = tagged.join(repositories, (F.col("repository_id") == F.col("id")) & (F.col("language") == F.col("l")))
        counts = used.groupBy("language", "framework").agg(F.count("*").alias("n"))
        first = top_per_group(used, ["language", "framework"], [F.desc("stars"), F.asc("owner"), F.asc("repo"), F.asc("id")], samples, "k")
        listed = first.groupBy("language", "framework").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws("/", "owner", "repo").alias("x")))), lambda s: s["x"]), ";").alias("x"))
        return (
            pairs.join(counts, ["language", "framework"], "left").join(listed, ["language", "framework"], "left")
            .select("language", "framework", F.coalesce("n", F.lit(0)).alias("repositories"), F.coalesce("x", F.lit("")).alias("samples"))
        )

    def register(self, spark: SparkSession) -> list[str]:
        """Temporary views of the newest rows, for `adhoc`; their names."""
        names = [name for name, table in self.tables.items() if table is not None]
        for name in names:
            self.final(name).createOrReplaceTempView(name)
        return names


REQUIRED = {"repositories", "artifacts"}
READ_ONLY = re.compile(r"[\s(]*(?:select|with|values|from)\b", re.I)
#: Statements that may begin with WITH or FROM and still write.
WRITES = re.compile(r"\b(?:insert\s+(?:into|overwrite)|create|drop|alter|truncate|delete\s+from|update|merge\s+into|load\s+data|refresh|cache|uncache|set|reset|add\s+jar|msck|analyze|grant|revoke|call)\b", re.I)


def missing_tables(spark: SparkSession) -> set[str]:
    """Tables that the queries need and the catalogue lacks."""
    return REQUIRED - {table.name for table in spark.catalog.listTables()}


def adhoc(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """The result of one read-only statement with named parameters; anything else raises PermissionError.

    The parsed plan is looked at, not only the text: a command or a write is never run.
    """
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    if not READ_ONLY.match(bare) or WRITES.search(bare):
        raise PermissionError("only SELECT statements are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    kinds = {plan.getClass().getSimpleName()} | {part.split()[0].strip("'+-: ") for part in plan.toString().splitlines() if part.split()}
    if any(k.endswith("Command") or k.startswith(("InsertInto", "CreateTable", "DropTable", "OverwriteBy", "AppendData")) for k in kinds):
        raise PermissionError("only SELECT statements are allowed")
    return spark.sql(text, args=args or {})
