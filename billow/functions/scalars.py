"""Scalar functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from billow.schemas import NO_DATE


def filled(*values: Column) -> Column:
    """The first value that is neither null nor ''; '' if there is none."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def normalize_path(path: Column) -> Column:
    """An API path to compare by: no query, lower case, one form for parameters, '/' first and none at the end.

    Null and '' give '/'. The order of the steps matters: {x}, then :x, then <x> become {}.
    """
    text = strip(F.lower(F.substring_index(F.coalesce(path, F.lit("")), "?", 1)))
    text = F.when(text != "/", F.regexp_replace(text, "/$", "")).otherwise(text)
    for pattern in (r"\{[^}]+\}", r":[a-zA-Z0-9_]+", r"<[^>]+>"):
        text = F.regexp_replace(text, pattern, "{}")
    return F.when(text.startswith("/"), text).otherwise(F.concat(F.lit("/"), text))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    """How many '/' a path has."""
    return F.length(F.regexp_replace(path, "[^/]", "")).cast("bigint")


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def version_path(ref: Column, sha: Column) -> Column:
    """<ref>/<sha>, HEAD for either that is missing or blank."""
    return F.concat_ws("/", filled(strip(ref), F.lit("HEAD")), filled(strip(sha), F.lit("HEAD")))


def tree_url(url: Column, release: Column, sha: Column) -> Column:
    """The page of a release tag, else of a commit, else of the repository."""
    return (
        F.when(F.coalesce(release, F.lit("")) != "", F.concat(url, F.lit("/releases/tag/"), release))
        .when(F.coalesce(sha, F.lit("")) != "", F.concat(url, F.lit("/tree/"), sha))
        .otherwise(url)
    )


def blob_url(url: Column, ref: Column, path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).otherwise(F.concat(url, F.lit("/blob/"), ref, F.lit("/"), path))


def ref_of(release: Column, branch: Column) -> Column:
    return filled(release, branch)


def tag_of(release: Column, sha: Column, branch: Column) -> Column:
    return filled(release, sha, branch)


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def ref_name(ref: Column) -> Column:
    """A ref without refs/tags/ or refs/heads/ before it and ^{} after it."""
    return F.regexp_replace(F.regexp_replace(ref, r"\^\{\}$", ""), "^refs/(tags|heads)/", "")


def masked(text: Column, secret: Column) -> Column:
    """The text with every occurrence of a secret as five asterisks; unchanged where there is no secret."""
    return F.when(F.coalesce(secret, F.lit("")) == "", text).otherwise(F.replace(text, secret, F.lit("*****")))


def iso_time(text: Column) -> Column:
    """An ISO-8601 time in UTC; null if it is none."""
    return F.try_to_timestamp(text)


def time_or_default(value: Column) -> Column:
    return F.coalesce(value, F.lit(NO_DATE).cast("timestamp"))


def day(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def middle(start: Column, end: Column) -> Column:
    """The day halfway between two, rounded down."""
    return F.date_add(start.cast("date"), F.floor(F.datediff(end, start) / 2).cast("int"))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; 0 where whole is 0 or null."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0)), digits)


def natural_size(size: Column) -> Column:
    """Bytes in decimal units: '999 Bytes', '1 Byte', '1.5 kB', '2.0 MB'."""
    units = ["kB", "MB", "GB", "TB", "PB"]
    out = F.when(size == 1, F.lit("1 Byte")).when(size < 1000, F.concat(size.cast("string"), F.lit(" Bytes")))
    for k, unit in enumerate(units, 1):
        scaled = F.format_string("%.1f " + unit, size.cast("double") / F.lit(float(1000**k)))
        out = out.when(size < 1000 ** (k + 1), scaled) if k < len(units) else out.otherwise(scaled)
    return out


def first_of_license(item: Column) -> Column:
    """The name of a licence that is text or an object as JSON: value, spdxExpression or name, the first not empty."""
    fields = filled(*[F.get_json_object(item, f"$.{f}") for f in ("value", "spdxExpression", "name")])
    return F.when(item.startswith("{"), fields).otherwise(item)


def license_names(items: Column) -> Column:
    """The names in a list of licences (JSON texts or plain texts), without those that are empty."""
    return F.coalesce(F.filter(F.transform(items, first_of_license), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def owner_name(owner: Column) -> Column:
    """The login of an owner that is text or an object as JSON."""
    return F.when(owner.startswith("{"), F.coalesce(F.get_json_object(owner, "$.login"), F.lit(""))).otherwise(F.coalesce(owner, F.lit("")))


def lines_of_code(text: Column) -> Column:
    """Lines as Python's splitlines counts them: all line ends count, an empty last line does not."""
    ends = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]", "\n")
    return (F.length(F.regexp_replace(ends, "[^\n]", "")) + F.when((ends != "") & ~ends.endswith("\n"), 1).otherwise(0)).cast("bigint")


def first_tags(category: Column, tags: Column) -> Column:
    """The first five tags of a web application; none for all else."""
    return F.when(category == "Web Application", F.slice(tags, 1, 5)).otherwise(F.array().cast("array<string>"))


def own_framework(category: Column, repo: Column, framework: Column) -> Column:
    """A web framework is its own framework."""
    return F.when(category == "Web Framework", repo).otherwise(framework)


def snippet(text: Column, length: int = 1000) -> Column:
    return F.left(text, F.lit(length))


def comma_list(text: Column) -> Column:
    """The trimmed parts of a text with commas, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def cache_name(model: Column) -> Column:
    return F.translate(model, ":", "/")


def python_bool(value: Column) -> Column:
    """'True' or 'False'."""
    return F.initcap(value.cast("string"))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def capped(text: Column, name: Column, most: int = 100, description: int = 50) -> Column:
    """How a table shows a text: a description by its first 50 characters, others by their first 100."""
    return F.when(name == "description", F.left(text, F.lit(description))).otherwise(F.left(text, F.lit(most)))
