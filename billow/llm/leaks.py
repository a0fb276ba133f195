"""Evaluation texts inside training text: an inverted index walked by block-max WAND, then an exact check."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billow.session import bounded, spread

#: Test items, and characters of their texts, that a task holds as one index.
ITEM_LIMIT, TEXT_LIMIT = 20_000, 32 << 20
#: Words of a training passage, and postings in a block of a list.
PASSAGE, BLOCK = 32, 64
K1, B = 1.2, 0.75
#: Taken out of a word: zero-width characters and marks, word joiners, soft hyphens.
INVISIBLE = dict.fromkeys([0x00AD, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF])
WORD, PLAIN_WORD = re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+")
FOUND = "key bigint, item bigint, words int, question boolean, answer boolean"
#: Lists that a task keeps unpacked, and the item of a list that has no more.
LISTS, END = 50_000, 1 << 62
STANDS_AT = itemgetter(0)


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, case folded."""
    if not text:
        return []
    if text.isascii():
        return PLAIN_WORD.findall(text.lower())
    return [w.casefold() for w in WORD.findall(text.translate(INVISIBLE))]


class Index:
    """BM25 impacts of terms in test items, divided by the least score of any run of `run` words of the item.

    A term is a pair of neighbouring words: single words of one trade are too common to tell passages apart. A text
    that holds such a run scores at least 1 for the item, so a threshold of 1 retrieves all of them. The list of a term
    holds its items in order with their impacts, and the last item and the greatest impact of every BLOCK of them. All
    lists lie one after another in arrays, so memory grows with the words of the items, and with nothing else.
    """

    def __init__(self, items: list[tuple[int, str, str, str]], run: int):
        if run < 2:
            raise ValueError("a run has two words or more")
        self.run = run
        texts = [(item, words_of(passage), question, answer) for item, passage, question, answer in sorted(items, key=lambda x: x[0])]
        texts = [x for x in texts if len(x[1]) >= run]
        self.items = np.array([x[0] for x in texts], np.int64)
        self.rest = [(x[2], x[3]) for x in texts]
        self.ids: dict[str, int] = {}
        for _, passage, _, _ in texts:
            for word in passage:
                self.ids.setdefault(word, len(self.ids))
        self.passages = [np.array([self.ids[w] for w in x[1]], np.int32) for x in texts]
        self.keys = np.unique(np.concatenate([self.pair_keys(p) for p in self.passages])) if texts else np.zeros(0, np.int64)
        terms = [self.terms(p) for p in self.passages]
        each = [np.unique(t, return_counts=True) for t in terms]
        df = np.bincount(np.concatenate([t for t, _ in each]), minlength=len(self.keys)) if texts else np.zeros(0, np.int64)
        idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
        mean = sum(map(len, terms)) / max(1, len(texts))
        impacts = []
        for t, (w, c) in zip(terms, each, strict=True):
            impact = idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(t) / mean))
            impacts.append(impact / self.least_score(t, impact[np.searchsorted(w, t)]))
        term = np.concatenate([w for w, _ in each]) if texts else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.offsets = np.zeros(len(self.keys) + 1, np.int64)
        np.cumsum(df, out=self.offsets[1:])
        self.post_item = np.repeat(np.arange(len(texts), dtype=np.int32), [len(w) for w, _ in each])[order]
        self.post_impact = np.concatenate(impacts)[order].astype(np.float32) * np.float32(1 + 1e-6) if texts else np.zeros(0, np.float32)
        self.lists: dict[int, tuple] = {}
        self.most = np.maximum.reduceat(self.post_impact, self.offsets[:-1]) if len(self.keys) else np.zeros(0, np.float32)

    def least_score(self, terms: np.ndarray, impact: np.ndarray) -> float:
        """The least sum of the impacts of the different terms in any run of the item: a window of run - 1 terms."""
        width = self.run - 1
        windows = np.lib.stride_tricks.sliding_window_view(terms, width)
        sums = np.lib.stride_tricks.sliding_window_view(impact, width).sum(axis=1)
        ordered = np.sort(windows, axis=1)
        for k in np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1)):  # a term that comes twice counts once
            sums[k] = impact[k : k + width][np.unique(windows[k], return_index=True)[1]].sum()
        return float(sums.min())

    def pair_keys(self, ids: np.ndarray) -> np.ndarray:
        return ids[:-1].astype(np.int64) * len(self.ids) + ids[1:]

    def terms(self, ids: np.ndarray) -> np.ndarray:
        """The term of each word and the one after it; -1 for what no item has."""
        if len(ids) < 2 or not len(self.keys):
            return np.full(max(0, len(ids) - 1), -1, np.int64)
        keys = self.pair_keys(ids)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (ids[:-1] >= 0) & (ids[1:] >= 0), at, -1)

    def posting(self, term: int) -> tuple:
        """The list of a term: items, impacts, and of every block its greatest impact and last item."""
        known = self.lists.get(term)
        if known is None:
            if len(self.lists) >= LISTS:
                self.lists.clear()
            low, high = int(self.offsets[term]), int(self.offsets[term + 1])
            items, impacts = self.post_item[low:high].tolist(), self.post_impact[low:high].tolist()
            starts = range(0, high - low, BLOCK)
            known = self.lists[term] = (items, impacts, [max(impacts[k : k + BLOCK]) for k in starts], [items[k : k + BLOCK][-1] for k in starts], float(self.most[term]))
        return known

    def walk(self, terms: list[int]) -> list[int]:
        """The items that score at least 1 for these terms, by block-max WAND.

        The lists are held in order of the item they stand at. The pivot is the first item at which the greatest
        impacts of the lists up to there reach 1: nothing before it can. If the greatest impacts of their blocks at the
        pivot reach 1 too, it is scored, or the lists before it are moved up to it; else they move on past the first of
        these blocks to end, or to the item of the next list.
        """
        lists = [[x[0][0], 0, *x] for x in map(self.posting, terms)]  # item, position, items, impacts, maxima, lasts, most
        found = []
        while True:
            lists.sort(key=STANDS_AT)
            upper, pivot = 0.0, -1
            for k, entry in enumerate(lists):
                upper += entry[6]
                if upper >= 1:
                    pivot = k
                    break
            if pivot < 0:
                return found
            target = lists[pivot][0]
            if target == END:
                return found
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
                pivot += 1
            bound, end = 0.0, END
            for entry in lists[: pivot + 1]:
                # The block that holds the first item of `target` or more.
                number = bisect_left(entry[5], target, entry[1] // BLOCK)
                if number < len(entry[5]):
                    bound += entry[4][number]
                    end = min(end, entry[5][number])
            if bound >= 1:
                if lists[0][0] == target:
                    if sum(x[3][x[1]] for x in lists[: pivot + 1]) >= 1:
                        found.append(target)
                    target += 1
            else:
                target = max(target + 1, min(end + 1, lists[pivot + 1][0] if pivot + 1 < len(lists) else END))
            for entry in lists[: pivot + 1]:
                if entry[0] < target:
                    entry[1] = at = bisect_left(entry[2], target, entry[1])
                    entry[0] = entry[2][at] if at < len(entry[2]) else END

    def retrieve(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, item) of every passage that scores at least 1 for the item.

        Passages overlap by run - 1 words, so each run lies in one of them. A run of an item is run - 1 neighbouring
        terms of the index, so terms with fewer known ones around them ask for nothing. Of most passages that are left
        the sum of the greatest impacts is under 1, which is the first pivot not found, for all passages at once. The
        others walk the lists.
        """
        size = max(PASSAGE, 2 * self.run)
        stride, width = size - self.run + 1, size - 1
        owner, passage, word, count = [], [], [], 0
        for t, ids in enumerate(texts):
            if len(ids) < self.run:
                continue
            terms = self.terms(ids)
            starts = np.arange(0, len(ids) - self.run + 1, stride)
            at = np.flatnonzero(terms >= 0)
            if len(at) < self.run - 1:
                continue
            borders = np.flatnonzero(at[1:] != at[:-1] + 1) + 1
            sizes = np.diff(np.concatenate(([0], borders, [len(at)])))
            at = at[np.repeat(sizes >= self.run - 1, sizes)]
            if not len(at):
                continue
            # A term lies in the passage that begins last before it, and in those before that reach it.
            for back in range(-(-width // stride)):
                number = at // stride - back
                fits = (number >= 0) & (number < len(starts)) & (at - number * stride < width)
                passage.append(count + number[fits])
                word.append(terms[at[fits]])
            owner.append(np.full(len(starts), t))
            count += len(starts)
        if not count:
            return set()
        owners, passages, terms = np.concatenate(owner), np.concatenate(passage), np.concatenate(word)
        pairs = np.unique(passages * len(self.keys) + terms)
        passages, terms = pairs // len(self.keys), pairs % len(self.keys)
        upper = np.bincount(passages, self.most[terms], minlength=count)
        keep = upper[passages] >= 1
        passages, terms = passages[keep], terms[keep]
        found: set[tuple[int, int]] = set()
        borders = [*np.flatnonzero(passages[1:] != passages[:-1]) + 1, len(passages)] if len(passages) else []
        for begin, end in zip([0, *borders], borders):  # noqa: B905 - the last border begins nothing
            owner_of = int(owners[passages[begin]])
            found.update((owner_of, k) for k in self.walk(terms[begin:end].tolist()))
        return found

    def longest(self, ids: np.ndarray, item: int) -> int:
        """Words of the longest run of a text that stands in an item's passage just so; 0 if it is under `run`."""
        passage = self.passages[item]
        order = np.argsort(passage, kind="stable")
        ordered = passage[order]
        low, high = np.searchsorted(ordered, ids, "left"), np.searchsorted(ordered, ids, "right")
        sizes = high - low
        total = int(sizes.sum())
        if not total:
            return 0
        # All places (i in the text, j in the passage) with the same word; a run is a line of i on one diagonal.
        i = np.repeat(np.arange(len(ids)), sizes)
        j = order[np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(total)]
        along = np.argsort((i - j) * (len(ids) + 1) + i, kind="stable")
        i, diagonal = i[along], (i - j)[along]
        breaks = np.flatnonzero(np.append(True, (i[1:] != i[:-1] + 1) | (diagonal[1:] != diagonal[:-1])))
        best = int(np.diff(np.append(breaks, total)).max())
        return best if best >= self.run else 0


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, question: str, answer: str, run: int = 12) -> DataFrame:
    """key, item, words, question, answer: every document that holds at least `run` consecutive words of an item's
    passage, in order, once for each item, with the words of the longest such run, and whether the text also holds the
    words of the question and of the answer.

    Null, empty and blank texts and passages give no row, nor do passages under `run` words. Items with a null id are
    left out; keys must be unique. The index is built on the driver and broadcast. Up to ITEM_LIMIT items with
    TEXT_LIMIT characters are one index (20,000 items of 100 words: README); more are indexed in several slices by their
    id, each with a broadcast and a pass over the documents of its own. Documents pass through maps; they are moved only
    if they come in fewer parts than there are cores.
    """
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text")).filter("text <> ''")
    rows = spread(rows, "key")
    wanted = items.select(F.col(f"`{item}`").alias("i"), F.col(f"`{passage}`").alias("p"), F.col(f"`{question}`").alias("q"), F.col(f"`{answer}`").alias("a")).filter("i IS NOT NULL").distinct()
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.length(F.concat_ws(" ", "p", "q", "a"))).alias("c")).first()
    slices = max(-(-size["n"] // ITEM_LIMIT), -(-(size["c"] or 0) // TEXT_LIMIT))
    if slices <= 1:
        found = search_items(rows, bounded(wanted, ITEM_LIMIT), run)
    else:
        parts = [search_items(rows, wanted.filter(F.pmod(F.xxhash64("i"), F.lit(2 * slices)) == k).collect(), run) for k in range(2 * slices)]
        found = reduce(DataFrame.unionByName, parts)
    best = found.groupBy("key", "item").agg(F.max("words").alias("words"), F.bool_or("question").alias("question"), F.bool_or("answer").alias("answer"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "words", "question", "answer")


def holds(joined: str, words: list[str]) -> bool:
    return bool(words) and " " + " ".join(words) + " " in joined


def search_items(rows: DataFrame, listed: list, run: int) -> DataFrame:
    """FOUND for rows(key, text) and the items listed as rows (i, p, q, a)."""
    shared = rows.sparkSession.sparkContext.broadcast(Index([(r["i"], r["p"], r["q"], r["a"]) for r in listed], run))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        number = index.ids.get
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                words = [words_of(value) for value in batch.column(1).to_pylist()]
                ids = [np.array([number(w, -1) for w in x], np.int32) for x in words]
                out: list[tuple] = []
                for t, k in sorted(index.retrieve(ids)):
                    if length := index.longest(ids[t], k):
                        joined = " " + " ".join(words[t]) + " "
                        out.append((batch.column(0)[t].as_py(), int(index.items[k]), length, *(holds(joined, words_of(x)) for x in index.rest[k])))
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["key", "item", "words", "question", "answer"])

    return rows.mapInArrow(search, FOUND)
