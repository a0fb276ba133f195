"""Freely typed values to the entries of a reference list: symmetric deletes, weighted edit distance."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from billow.session import bounded, cut
from billow.tables import blank

#: Entries of a reference list that may be held by every task; a longer one is joined.
LIST_LIMIT = 100_000

#: Fixed words of the grammar of licence names.
NUMBERS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
FLAVOURS = {"only": "only", "later": "later", "newer": "later", "above": "later", "higher": "later"}
FILLERS = ["the", "under", "licensed", "license", "licence", "version", "ver", "or", "any", "and", "clause", "lic", "terms", "released", "this", "software", "is"]

GRAMMAR = [*FILLERS, *FLAVOURS, *NUMBERS]

#: Fixed words for kinds of licence: they tell no licence from another by themselves.
KINDS = frozenset("general public license licence software source community permissive agreement free open documentation lesser library data".split())


def edit_bound(length: int) -> int:
    """Edits allowed for a word of that many letters."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 14 else 3


def weighted_damerau(a: str, b: str, limit: float = 3.0) -> float:
    """Edit distance with swaps of neighbours: a swap or a doubled letter weighs 0.7, another edit 1, and an edit of
    the first letter 0.3 more. Beyond `limit` it may return infinity early."""
    if abs(len(a) - len(b)) > limit / 0.7:
        return float("inf")
    before: list[float] = []
    row = [0.0] + [0.0] * len(b)
    for j, y in enumerate(b):
        row[j + 1] = row[j] + (1.3 if j == 0 else 0.7 if y == b[j - 1] else 1.0)
    for i, x in enumerate(a):
        new = [row[0] + (1.3 if i == 0 else 0.7 if x == a[i - 1] else 1.0)]
        first = 0.3 if i == 0 else 0.0
        for j, y in enumerate(b):
            cost = row[j] + (0.0 if x == y else 1.0 + (first if j == 0 else 0.0))
            cost = min(cost, row[j + 1] + (0.7 if i and x == a[i - 1] else 1.0) + (first if j == 0 else 0.0))
            cost = min(cost, new[j] + (0.7 if j and y == b[j - 1] else 1.0) + (first if j == 0 else 0.0))
            if i and j and x == b[j - 1] and y == a[i - 1] and x != y:
                cost = min(cost, before[j - 1] + 0.7)
            new.append(cost)
        if min(new) > limit:
            return float("inf")
        before, row = row, new
    return row[-1]


def damerau(a: str, b: str, limit: int) -> int:
    """Edits between a and b, a swap of neighbours being one; limit + 1 if there are more than that."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            cost = min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1)
            if i and j and x == b[j - 1] and y == a[i - 1]:
                cost = min(cost, before[j - 1] + 1)
            new.append(cost)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return row[-1]


def deletes(word: str, distance: int) -> set[str]:
    """word and all that is left of it after up to `distance` letters are taken out."""
    return {"".join(word[i] for i in range(len(word)) if i not in out) for k in range(min(distance, len(word)) + 1) for out in map(set, itertools.combinations(range(len(word)), k))}


class SymmetricDelete:
    """Words of a dictionary within a bounded edit distance of a given one. Two words at most d edits apart share a
    string that each becomes by at most d deletes, so deletes are made of both sides and looked up, never all edits."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.table: dict[str, list[str]] = defaultdict(list)
        for word in sorted(words):
            for short in deletes(word, edit_bound(len(word))):
                self.table[short].append(word)
        self.longest = max(map(len, words), default=0)
        self.__setstate__({})

    def __getstate__(self) -> dict:
        """The dictionary without what this process has looked up; a worker starts its own cache and keeps it."""
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.lookup = lru_cache(200_000)(self.lookup_uncached)

    def lookup_uncached(self, term: str) -> tuple[tuple[float, int, str], ...]:
        """(weighted distance, -frequency, word), nearest first, more frequent first among equals."""
        if term in self.words:
            return ((0.0, -self.words[term], term),)
        if len(term) > self.longest + 3 or len(term) < 2:
            return ()
        seen = {word for short in deletes(term, edit_bound(len(term) + 1)) for word in self.table.get(short, ())}
        near = [(weighted_damerau(term, word), -self.words[word], word) for word in seen if damerau(term, word, bound := edit_bound(max(len(word), 1))) <= bound]
        return tuple(sorted(x for x in near if x[0] < 4))


def plain(text: str) -> str:
    """Compatibility forms, lower case, invisible characters out, dashes as '-'."""
    text = unicodedata.normalize("NFKC", text).casefold()
    text = "".join("-" if unicodedata.category(c) == "Pd" or c == "−" else c for c in text if unicodedata.category(c) != "Cf")
    return " ".join(text.split())


TOKEN = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*|\+")
VERSION_MARK = re.compile(r"(?<=[^\W\d_])v(?=\.?\s*\d)")
URL = re.compile(r"^(?:[a-z]+://\S+|(?:[\w-]+\.)+[a-z]{2,}/\S+)$")
SPLIT = re.compile(r"\s*[|;&,]\s*|\s+/\s+|/|\s+(?:and|with)\s+|\s+or\s+(?!(?:any\s+)?(?:[a-z]*\s+)?(?:later|newer|above|higher)\b)|\s+\+\s+")

OR_LATER = re.compile(r"(\d\W+or\W+(?:any\W+)?)([a-z]{3,8})\b")


def number(text: str) -> tuple[int, ...]:
    """2.0, 2 and 2.0.0 are the same version."""
    parts = [int(x) for x in text.split(".")]
    while len(parts) > 1 and parts[-1] == 0:
        parts.pop()
    return tuple(parts)


def bare(value: str) -> str:
    """A value in plain form; of an address what names the entry."""
    text = plain(value)
    if URL.match(text):
        text = re.sub(r"[?#].*$", "", text).rstrip("/").rsplit("/", 1)[-1]
        text = re.sub(r"\.(?:html?|txt|md|php|json|xml)$", "", text)
    return text


def parted(text: str) -> tuple[str, list[str]]:
    """A plain text, and its parts at separators. After a version and 'or', what is like 'later' is that; else it would be
    taken for a second licence."""
    text = OR_LATER.sub(lambda m: m[1] + "later" if damerau(m[2], "later", 2) <= 2 else m[0], text)
    return text, [p for p in SPLIT.split(text) if p and p.strip()]


def tokens_in(text: str) -> list[str]:
    return TOKEN.findall(VERSION_MARK.sub(" v ", text))


def looked_up(value: str) -> list[str]:
    """The words of a value, of which nearest words are wanted."""
    text, parts = parted(bare(value))
    return sorted({t for x in (text, *parts) for t in tokens_in(x) if t != "+" and not t[0].isdigit() and t != "v"})


class Entry:
    def __init__(self, key: str, name: str):
        self.key, self.name = key, name
        words, self.numbers, self.flavour = [], [], ""
        for token in tokens_in(plain(name)):
            if token[0].isdigit():
                self.numbers.append(number(token))
            elif token in FLAVOURS:
                self.flavour = FLAVOURS[token]
            elif token not in ("v", "version", "or", "clause", "+"):
                words.append(token)
        self.words = tuple(words)
        letters = [t for t in tokens_in(plain(key)) if not t[0].isdigit() and t not in FLAVOURS and t not in ("v", "or", "clause", "+")]
        self.short = tuple(letters)


def marks_of(family: tuple, alone: set[str]) -> set[str]:
    """The words of a family that tell it; `alone`: those that no other family has. Words too short to be corrected are
    not asked for beside longer ones."""
    marks = {w for w in alone if w not in KINDS} or alone or set(family)
    return {w for w in marks if len(w) >= 4} or marks


def initials_of(family: tuple, alone: set[str]) -> list[str]:
    """Initials that may stand for the kind of licence after its own name."""
    initials = "".join(w[0] for w in family)
    names = max((k + 1 for k, w in enumerate(family) if w not in KINDS and w in alone), default=0)
    return [initials[k:] for k in range(max(1, names), len(initials) - 1)]


class Matcher:
    """Reads a value as the names, versions and flavours of entries. frequency: rows that hold an entry as it stands."""

    def __init__(self, entries: Iterable[tuple[str, str]], frequency: dict[str, int] | None = None):
        frequency = frequency or {}
        self.entries = [Entry(key, name) for key, name in sorted(entries)]
        self.exact: dict[str, str] = {}
        for e in self.entries:
            self.exact.setdefault(plain(e.name), e.key)
        for e in self.entries:
            self.exact[plain(e.key)] = e.key
        self.families: dict[tuple, list[Entry]] = defaultdict(list)
        for e in self.entries:
            self.families[e.words].append(e)
        holders: dict[str, set] = defaultdict(set)
        for family in self.families:
            for word in family:
                holders[word].add(family)
        self.distinctive = {f: marks_of(f, {w for w in f if len(holders[w]) == 1}) for f in self.families}
        self.shorts: dict[str, set] = defaultdict(set)
        words: dict[str, int] = defaultdict(int)
        for family, members in self.families.items():
            weight = sum(frequency.get(x, 0) for e in members for x in (e.key, e.name))
            for word in family:
                words[word] += weight
            for e in members:
                if len(e.short) == 1 and e.short[0] not in family:
                    self.shorts[e.short[0]].add(family)
                    words[e.short[0]] += weight
            for word in initials_of(family, {w for w in family if len(holders[w]) == 1}):
                words[word] += 0
        for word in GRAMMAR:
            words[word] += 0
        self.index = SymmetricDelete(dict(words))
        self.of_word: dict[str, set] = defaultdict(set)
        for family, marks in self.distinctive.items():
            for word in marks:
                self.of_word[word].add(family)

    def segment(self, token: str) -> list[str] | None:
        """The cheapest way to read a run of letters as dictionary words written without blanks."""
        best: list[tuple[float, list[str]] | None] = [(0.0, [])] + [None] * len(token)
        for i in range(len(token)):
            if best[i] is None:
                continue
            cost, words = best[i]
            for j in range(i + 2, min(len(token), i + self.index.longest + 2) + 1):
                found = self.index.lookup(token[i:j])
                if not found or (len(token[i:j]) < 4 and found[0][0] > 0) or found[0][0] > 1.5:
                    continue
                total = cost + 0.1 + found[0][0] + (0.6 if j - i < 4 else 0.0)
                if best[j] is None or total < best[j][0]:
                    best[j] = (total, [*words, found[0][2]])
        return best[-1][1] if best[-1] is not None else None

    def read(self, text: str) -> tuple[list[tuple[str, object]], dict[str, float]]:
        """Tokens as ('word', w), ('number', n), ('plus', None) or ('unknown', t), and each word's distance."""
        out: list[tuple[str, object]] = []
        far: dict[str, float] = {}
        for token in tokens_in(text):
            if token == "+":
                out.append(("plus", None))
            elif token[0].isdigit():
                out.append(("number", number(token)))
            elif token == "v":
                continue
            elif (found := self.index.lookup(token)) and (len(token) >= 4 or found[0][0] == 0 or found[0][2] in FLAVOURS):
                best = found[0][2]
                far[best] = min(found[0][0], far.get(best, 9.0))
                out.append(("number", (NUMBERS[best],)) if best in NUMBERS else ("word", best))
            elif len(token) >= 6 and (words := self.segment(token)):
                out += [("number", (NUMBERS[w],)) if w in NUMBERS else ("word", w) for w in words]
            else:
                out.append(("unknown", token))
        return out, far

    def families_in(self, words: set[str], far: dict[str, float]) -> set[tuple]:
        """Families named by their short form or by at least half the letters of their own words. Where several are,
        one that is read with more corrections than another by half an edit is taken for a chance likeness."""
        found = {f for w in words & set(self.shorts) for f in self.shorts[w]}
        named = {f for w in words for f in self.of_word.get(w, ()) if 2 * sum(map(len, self.distinctive[f] & words)) >= sum(map(len, self.distinctive[f]))}
        if named:
            most = max(sum(w in words for w in f) for f in named)
            shared = [f for f in named if not any(self.distinctive[f] == self.distinctive[g] and f != g for g in named)]
            named = {f for f in named if f in shared or sum(w in words for w in f) == most}
        found |= named
        if len(found) > 1:
            cost = {f: min(far.get(w, 0.0) for w in words if w in self.distinctive[f] or f in self.shorts.get(w, ())) for f in found}
            found = {f for f in found if cost[f] <= min(cost.values()) + 0.5}
        return found

    def whole(self, text: str) -> set[str]:
        """Entries that a text without separators names."""
        tokens, far = self.read(text)
        families = self.families_in({w for kind, w in tokens if kind == "word"}, far)
        if not families:
            return set()
        if len(families) > 1:
            return self.several(tokens, families)
        return self.pick(next(iter(families)), tokens)

    def several(self, tokens: list, families: set[tuple]) -> set[str]:
        """A text that names several families: what stands between two names belongs to the one before, what stands
        before the first name to that."""
        starts, seen = [], set()
        for k, (kind, w) in enumerate(tokens):
            if kind == "word":
                for f in families:
                    if f not in seen and (w in self.distinctive[f] or f in self.shorts.get(w, ())):
                        seen.add(f)
                        starts.append((k, f))
        out: set[str] = set()
        for n, (k, family) in enumerate(starts):
            out |= self.pick(family, tokens[0 if n == 0 else k : starts[n + 1][0] if n + 1 < len(starts) else len(tokens)])
        return out

    def pick(self, family: tuple, tokens: list) -> set[str]:
        members = self.families[family]
        numbers = {n for kind, n in tokens if kind == "number"}
        words = {w for kind, w in tokens if kind == "word"}
        later = any(FLAVOURS.get(w) == "later" for w in words) or any(kind == "plus" for kind, _ in tokens)
        flavour = "later" if later else "only"
        flavoured = any(e.flavour for e in members)
        fit = [e for e in members if not flavoured or (e.flavour or "only") == flavour]
        if not numbers:
            return {e.key for e in fit} if len(fit) == 1 and (not fit[0].numbers or len(members) == 1) else set()
        return {e.key for e in fit if e.numbers and set(e.numbers) <= numbers}

    def match(self, value: str) -> list[str]:
        """The keys of the entries that a value means, sorted; empty for none."""
        text = bare(value)
        if text in self.exact:
            return [self.exact[text]]
        text, parts = parted(text)
        if len(parts) > 1:
            named = [self.whole(p) for p in parts]
            if sum(map(bool, named)) > 1:
                return sorted(set().union(*named))
        return sorted(self.whole(text))


def canonical(values: DataFrame, value: str, entries: DataFrame, key: str, name: str, frequency: DataFrame | None = None) -> DataFrame:
    """raw_value, entry: the entries that each value means, one row each; '' for a value that means none.

    `values` should be distinct; nulls are left out. Values that equal a key or name are mapped like others. The list
    is read to the driver, made a dictionary with all its deletes once, and that is broadcast: a worker process unpacks
    it once and keeps it, with what it has looked up, from task to task. LIST_LIMIT bounds it; a longer list goes through
    `canonical_by_join`, with the same result. Entries with a null key or name are left out. Words of a value are looked up among words of the list by symmetric deletes and ranked by weighted edit
    distance, then by frequency of the entries that hold them; numbers are never corrected, so a version that the list
    lacks gives no entry. frequency(value, n): rows that hold an entry as it stands. Starts two small jobs.
    """
    named = entries.select(F.col(f"`{key}`").alias("k"), F.col(f"`{name}`").alias("n")).dropna()
    listed = bounded(named, LIST_LIMIT)
    if listed is None:
        return canonical_by_join(values, value, named, frequency)
    counts = {}
    if frequency is not None:
        exact = named.select(F.explode(F.array("k", "n")).alias("value")).distinct()
        counts = {r["value"]: r["n"] for r in frequency.join(F.broadcast(exact), "value", "left_semi").collect()}
    shared = values.sparkSession.sparkContext.broadcast(Matcher([(r["k"], r["n"]) for r in listed], counts))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher: Matcher = shared.value
        for batch in batches:
            found = [(v, e) for v in batch.column(0).to_pylist() for e in matcher.match(v) or [""]]
            yield pa.record_batch([pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else ((), ()))], ["raw_value", "entry"])

    return values.select(F.col(value).alias("raw_value")).filter("raw_value IS NOT NULL").mapInArrow(resolve, "raw_value string, entry string")


class Part(Matcher):
    """What a matcher of the whole list would hold that one value asks for."""

    def __init__(self, lookups: list, longest: int, families: list, exact: str | None, text: str):
        found = {r["t"]: ((r["d"], 0, r["word"]),) for r in lookups}
        self.index = self
        self.longest, self.lookup = longest, lambda t: found.get(t, ())
        self.exact = {} if exact is None else {text: exact}
        self.families = {tuple(r["family"]): [Entry(m["k"], m["n"]) for m in r["members"]] for r in families}
        self.distinctive = {tuple(r["family"]): set(r["marks"]) for r in families}
        self.shorts: dict[str, set] = defaultdict(set)
        self.of_word: dict[str, set] = defaultdict(set)
        for r in families:
            for word in r["marks"]:
                self.of_word[word].add(tuple(r["family"]))
            for word in r["shorts"]:
                self.shorts[word].add(tuple(r["family"]))


def by_batch(df: DataFrame, schema: str, function: Callable[[list[dict]], Iterator[tuple]]) -> DataFrame:
    """The rows that `function` makes of the rows of each batch."""
    names = [x.split()[0] for x in re.split(r",\s*(?![^<]*>)", schema)]
    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = function(batch.to_pylist())
            while part := list(itertools.islice(rows, 20_000)):
                yield pa.record_batch([pa.array(c, kinds.field(name).type) for name, c in zip(names, zip(*part, strict=True), strict=True)], names)

    return df.mapInArrow(run, schema)


def nearest(terms: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """t, d, word: the nearest word of terms(t), by (distance, frequency, word), of words(word, n): exact words first, for
    the others words that share a string with them after deletes, which is what the two sides are joined on."""
    same = terms.join(words.select(F.col("word").alias("t")), "t").select("t", F.lit(0.0).alias("d"), F.col("t").alias("word"))
    rest = terms.join(words.select(F.col("word").alias("t")), "t", "left_anti").filter(F.length("t").between(2, longest + 3))
    left = by_batch(rest, "short string, t string", lambda rows: ((x, r["t"]) for r in rows for x in deletes(r["t"], edit_bound(len(r["t"]) + 1))))
    right = by_batch(words, "short string, word string, n bigint", lambda rows: ((x, r["word"], r["n"]) for r in rows for x in deletes(r["word"], edit_bound(len(r["word"])))))
    met = left.join(right, "short").select("t", "word", "n").distinct()

    def check(rows: list[dict]) -> Iterator[tuple]:
        for r in rows:
            bound = edit_bound(max(len(r["word"]), 1))
            if damerau(r["t"], r["word"], bound) <= bound and (d := weighted_damerau(r["t"], r["word"])) < 4:
                yield r["t"], r["word"], r["n"], d

    near = by_batch(met, "t string, word string, n bigint, d double", check)
    best = near.groupBy("t").agg(F.min(F.struct("d", (-F.col("n")).alias("m"), "word")).alias("b"))
    return same.unionByName(best.select("t", "b.d", "b.word"))


def canonical_by_join(values: DataFrame, value: str, entries: DataFrame, frequency: DataFrame | None) -> DataFrame:
    """`canonical` for a list entries(k, n) of any length: nothing of it is broadcast or held as a whole. Words of values
    meet words of the list on what is left of both after deletes; each value then gets its nearest words and the families
    that these name, and is read with them as it would be with the whole list. Starts a job for the longest word."""
    rows = by_batch(entries, "k string, n string, family array<string>, short string, ek string, en string", lambda rows: ((r["k"], r["n"], list(e.words), e.short[0] if len(e.short) == 1 and e.short[0] not in e.words else None, plain(r["k"]), plain(r["n"])) for r in rows for e in (Entry(r["k"], r["n"]),)))
    by_name = rows.groupBy(F.col("en").alias("text")).agg(F.min(F.struct("k", "n")).alias("first"))
    by_key = rows.groupBy(F.col("ek").alias("text")).agg(F.max("k").alias("last"))
    exact = by_key.join(by_name, "text", "full").select("text", F.coalesce("last", "first.k").alias("exact"))
    families = rows.select("family").distinct()
    each = families.select("family", F.explode_outer(F.array_distinct("family")).alias("w"))
    held = each.groupBy("w").agg(F.count("*").alias("holders"))
    alone = each.join(held, "w", "left").groupBy("family").agg(F.collect_set(F.when(F.col("holders") == 1, F.col("w"))).alias("alone"))
    told = by_batch(alone, "family array<string>, marks array<string>, initials array<string>", lambda rows: ((r["family"], sorted(marks_of(tuple(r["family"]), set(r["alone"]))), initials_of(tuple(r["family"]), set(r["alone"]))) for r in rows))
    weights = families.select("family", F.lit(0).cast("bigint").alias("weight"))
    if frequency is not None:
        sides = rows.select("family", F.col("k").alias("value")).unionByName(rows.select("family", F.col("n").alias("value")))
        weights = weights.unionByName(sides.join(frequency.select("value", F.col("n").alias("weight")), "value").select("family", "weight"))
    weights = weights.groupBy("family").agg(F.sum("weight").alias("weight"))
    of_entry = rows.filter("short IS NOT NULL").join(weights, "family").select(F.col("short").alias("word"), "weight")
    of_family = weights.select(F.explode("family").alias("word"), "weight")
    plainly = told.select(F.explode("initials").alias("word")).unionByName(values.sparkSession.createDataFrame([(w,) for w in GRAMMAR], "word string")).select("word", F.lit(0).cast("bigint").alias("weight"))
    words = of_entry.unionByName(of_family).unionByName(plainly).groupBy("word").agg(F.sum("weight").alias("n"))
    longest = words.agg(F.max(F.length("word")).alias("m")).first()["m"]
    shorts = rows.groupBy("family").agg(F.collect_set("short").alias("shorts"), F.collect_list(F.struct("k", "n")).alias("members"))
    whole = told.select("family", "marks").join(shorts, "family")
    names = whole.select("family", F.explode(F.array_union("marks", "shorts")).alias("word"))

    wanted = values.select(F.col(value).alias("raw_value")).filter("raw_value IS NOT NULL")
    read = by_batch(wanted.distinct(), "raw_value string, text string, tokens array<string>", lambda rows: ((r["raw_value"], bare(r["raw_value"]), looked_up(r["raw_value"])) for r in rows))
    tokens = read.select("raw_value", F.explode("tokens").alias("token"))
    terms = tokens.select(F.col("token").alias("t")).distinct()
    first = nearest(terms, words, longest)
    # What is no word by itself may be several written without blanks.
    joined = terms.join(first.select("t"), "t", "left_anti").filter(F.length("t") >= 6)
    pieces = by_batch(joined, "token string, t string", lambda rows: ((r["t"], r["t"][i:j]) for r in rows for i in range(len(r["t"])) for j in range(i + 2, min(len(r["t"]), i + longest + 2) + 1))).distinct()
    second = pieces.join(nearest(pieces.select("t").distinct(), words, longest), "t")
    near = first.select(F.col("t").alias("token"), "t", "d", "word").unionByName(second.select("token", "t", "d", "word"))
    found = tokens.join(near, "token").select("raw_value", "t", "d", "word").distinct()
    lookups = found.groupBy("raw_value").agg(F.collect_list(F.struct("t", "d", "word")).alias("lookups"))
    meant = found.join(names, "word").select("raw_value", "family").distinct().join(whole, "family").groupBy("raw_value").agg(F.collect_list(F.struct("family", "marks", "shorts", "members")).alias("families"))
    full = read.select("raw_value", "text").join(exact, "text", "left").join(lookups, "raw_value", "left").join(meant, "raw_value", "left")

    def match(rows: list[dict]) -> Iterator[tuple]:
        for r in rows:
            part = Part(r["lookups"] or [], longest, r["families"] or [], r["exact"], r["text"])
            for entry in part.match(r["raw_value"]) or [""]:
                yield r["raw_value"], entry

    return wanted.join(by_batch(full, "raw_value string, entry string", match), "raw_value")


def counted_values(values: DataFrame, value: str) -> DataFrame:
    """value, n: each different value with its number of rows, written to the checkpoint folder, so that the input is
    read once for frequencies and for what is to be mapped."""
    return cut(values.select(F.col(value).alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")))


def free_values(counted: DataFrame, entries: DataFrame, key: str, name: str) -> DataFrame:
    """The rows (value, n) of counted values that are not blank and not equal to a key or name."""
    exact = entries.select(F.explode(F.array(key, name)).alias("value")).dropna().distinct()
    return counted.filter(~blank("value")).join(exact, "value", "left_anti")
