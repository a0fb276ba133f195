"""A data source over saved search results, split into partitions by ranges of stars, and by days where one value has many."""

from __future__ import annotations

import datetime as dt
import glob
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A search shows at most this many results, so a range must hold fewer.
RESULTS = 1000


class StarRange(InputPartition):
    """Results by stars and, where days are given, by the day of creation; `undated` takes those without one too."""

    def __init__(self, low: int, high: int | None, days: tuple[dt.date, dt.date] | None = None, undated: bool = True, names: tuple[str, ...] = ()):
        super().__init__((low, high, days, undated, names))
        self.low, self.high, self.days, self.undated, self.names = low, high, days, undated, names

    def holds(self, stars: int, day: dt.date | None) -> bool:
        if stars < self.low or (self.high is not None and stars > self.high):
            return False
        if day is None:
            return self.undated
        return self.days is None or self.days[0] <= day <= self.days[1]


def day_of(item: dict) -> dt.date | None:
    """The day of creation of a result, if it has one."""
    try:
        return dt.date.fromisoformat(str(item.get("created_at") or "")[:10])
    except ValueError:
        return None


def star_ranges(counts: dict[int, int], least: int, most: int = RESULTS) -> list[tuple[int, int | None]]:
    """Ranges [low, high] of stars, from the top down, that hold fewer than `most` results each; the top one is open.

    A single number of stars with more results is a range of its own, which `SearchReader.partitions` splits further by `day_ranges`.
    """
    ranges, high, held = [], None, 0
    low_of: int | None = None
    for stars in sorted((s for s in counts if s >= least), reverse=True):
        if held and held + counts[stars] >= most:
            ranges.append((low_of, high))
            high, held = low_of - 1, 0
        held += counts[stars]
        low_of = stars
    ranges.append((least, high))
    return ranges


def day_ranges(counts: dict[dt.date, int], start: dt.date, end: dt.date, most: int = RESULTS) -> list[tuple[dt.date, dt.date]]:
    """Halves a span of days until each holds fewer than `most` results or is one day."""
    held = sum(n for day, n in counts.items() if start <= day <= end)
    if held < most or start >= end:
        return [(start, end)]
    middle = start + (end - start) // 2
    return day_ranges(counts, start, middle, most) + day_ranges(counts, middle + dt.timedelta(days=1), end, most)


def items_of(name: str) -> Iterator[dict]:
    with open(name, encoding="utf-8") as file:
        yield from json.load(file).get("items", [])


def stars_of(item: dict) -> int:
    return int(item.get("stargazers_count") or 0)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.least = options["path"], int(options.get("least", 0))
        self.most = int(options.get("most", RESULTS))

    def partitions(self) -> list[StarRange]:
        """Ranges with the files that have any of their results: one pass over the pages, keeping counts only. As pages
        come in order of stars, a range lies in few of them and a page is read by few ranges."""
        counts: dict[int, int] = {}
        files_of: dict[int, dict[str, None]] = {}
        days: dict[int, dict[dt.date | None, int]] = {}
        for name in sorted(glob.glob(self.path)):
            for item in items_of(name):
                if (stars := stars_of(item)) >= self.least:
                    counts[stars] = counts.get(stars, 0) + 1
                    files_of.setdefault(stars, {})[name] = None
                    of_day = days.setdefault(stars, {})
                    day = day_of(item)
                    of_day[day] = of_day.get(day, 0) + 1
        out = []
        order = sorted(counts)
        for low, high in star_ranges(counts, self.least, self.most):
            held = order[bisect_left(order, low) : len(order) if high is None else bisect_right(order, high)]
            names = tuple(sorted({name for stars in held for name in files_of[stars]}))
            # Only a range with a single number of stars reaches `most`.
            hot = days[held[0]] if len(held) == 1 and counts[held[0]] >= self.most else {}
            dated = {day: n for day, n in hot.items() if day is not None}
            if not dated:
                out.append(StarRange(low, high, names=names))
                continue
            out += [StarRange(low, high, span, False, names) for span in day_ranges(dated, min(dated), max(dated), self.most)]
            if None in hot:
                out.append(StarRange(low, high, (dt.date.max, dt.date.min), True, names))
        return out

    def read(self, partition: StarRange) -> Iterator[tuple]:
        for name in partition.names:
            for item in items_of(name):
                stars = stars_of(item)
                if partition.holds(stars, day_of(item)):
                    owner = item.get("owner")
                    yield item.get("id"), owner.get("login") if isinstance(owner, dict) else owner, item.get("name"), stars, item.get("html_url"), item.get("created_at"), item.get("language")


class SearchSource(DataSource):
    """format "repository_search": option path (a pattern of saved result pages, JSON with `items`), least (stars), most.

    Pages are what a search service returned; fetching them is left to a collector, and this source reads any number of
    them in parallel ranges, as the service would have to be asked. Python opens the pages, so on a cluster their folder
    must be mounted on all machines.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_search"

    def schema(self) -> str:
        return "id bigint, owner string, repo string, stars bigint, url string, created_at string, language string"

    def reader(self, schema) -> SearchReader:  # noqa: ANN001
        return SearchReader(self.options)
