"""Pages of piled-up keywords, links, menus or tags instead of sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billow.session import cut, spread

#: Fixed function words by language; a language without word borders has characters instead.
FUNCTION_WORDS = {
    "en": "the a an and or of to in is are was were be been has have had for with on that this these those it its by from as at not but if you your we our they their i can will would when than there then which who what so no only also into out up about per because before after until while between both each every any some isn't don't hasn't hadn't didn't won't i've we've there's it's",
    "de": "der die das den dem des ein eine einer einem einen und oder ist sind war waren wird werden nicht mit von zu zum zur im in auf für an bei aus nach über unter sich es sie wir ihr ich als auch nur noch nun wenn dass ab keine durch um so",
    "es": "el la los las un una unos unas y o de del al en es son fue con por para que se no más su sus como si lo le ya entre sobre desde hasta ha han hemos este esta cuando qué",
    "fr": "le la les un une des et ou de du au aux en est sont été a ont pour par sur dans avec que qui se ne pas plus ce cette ces il elle nous vous leur son sa ses depuis entre l' d' n'est",
    "pt": "o a os as um uma e ou de do da dos das no na nos nas em é são foi com por para que se não mais seu sua como já quando entre",
    "it": "il lo la gli le un una e o di del della dei in nel nella è sono con per che si non più come da dal alla ha hanno quando tra",
    "nl": "de het een en of van in is zijn was met voor op aan dat die niet te er ook als naar bij door om uit wordt worden",
    "pl": "i w z na do nie się że jest są to jak po od przez dla o oraz ale który która",
    "sv": "och i att det som en ett är på för med av till den inte om har de kan när från",
    "tr": "ve bir bu için ile de da olarak olan gibi daha çok ama her veya değil",
    "ru": "и в во на с со для по из не что это как к от за до при или но бы был была были его их мы вы он она оно они если уже еще только",
    "el": "ο η το οι τα του της των και να με σε για από που δεν είναι στο στη στην κάθε θα τον την",
    "ar": "في من على إلى الى عن مع هذا هذه ذلك تلك التي الذي الذين أن إن لا ما لم لن كان كانت يكون هو هي هم و أو ثم قد بعد قبل عند كل بين حتى إذا كما لكن أي يتم تم غير منذ حيث عندما ولا وفي ومن",
    "fa": "و در به از که این را با است برای آن یک تا بر هم نیز می شود شده شد بود هر یا اگر ما نمی باید کرد کند هستند پس پیش",
    "ur": "کے کی کا میں ہے اور سے کو پر ہیں یہ نے کہ اس ایک تھا تھی بھی نہیں ہو کر یا جو تو اگر بعد لیے گیا",
}
WORDS = {language: frozenset(text.split()) for language, text in FUNCTION_WORDS.items()}
#: Each function word with its languages, so that a token is looked up once.
LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _language, _words in WORDS.items():
    for _word in _words:
        LANGUAGES_OF[_word] = (*LANGUAGES_OF.get(_word, ()), _language)
CHINESE = re.compile("的|了|是|在|请|我们|从|将|之后|如果|为|与|和|时|已|被|也|就|都|还|把|或|需要|這|这|该")
KANA, HANGUL = re.compile("[ぁ-ゖ]"), re.compile("[가-힣]+")
#: Particles and verb endings. `の` and the endings that Korean nouns share (가, 고, 어, 이, 의, 로) say nothing of a sentence.
JAPANESE = re.compile(r"(?<=\w)(?:は(?!じ)|が|を)|です|ます|ました|ません|ください|して|した|する|され|から|まで|では|には|ない|れば|ので")
KOREAN = re.compile("[가-힣](?:는|은|을|를|에서|에게|으로|까지|부터|보다|니다|니까|세요|시오|어요|아요|해요|했다|한다|된다|있다|없다|이다|였다|하는|하고|되어|해서|하여|하면|되면|지만)(?=$|[^가-힣])")
#: The Arabic article is a prefix, with or without a conjunction or preposition before it.
ARABIC, ARTICLE = re.compile(r"[ء-ۿ]+"), re.compile(r"(?<![ء-ۿ])[وف]?(?:ال|بال|كال|لل)[ء-ۿ]{2,}")
SCRIPT = {"ru": "Cyrillic", "el": "Greek", "ar": "Arabic", "fa": "Arabic", "ur": "Arabic"}
HAN, WIDE = re.compile("[一-鿿]"), re.compile("[一-鿿ぁ-ヿ가-힣]")

URL = r"(?:https?://|www\.)[^\s<>\"'）)|,;，；]+"
LINK = re.compile(rf"<a\b[^>]*>.*?</a>|!?\[[^\]\n]*\]\([^)\s]*\)|<{URL}>|{URL}", re.I)
LINKED = re.compile(r"://|www\.|\]\(|</a>", re.I)
TAG = re.compile(r"(?<![\w&/])#[^\s#,;|]+")
MARKUP = re.compile(r"</?[a-z][^>]{0,200}>", re.I)
FENCE = re.compile(r"^\s*(?:```|~~~)")
LOG = re.compile(r"^\s*(?:\$ |> |>>> |\[?\d{4}-\d\d-\d\d[T ]\d\d:|\[?\d\d:\d\d:\d\d|(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE)\b)")
CODE = re.compile(r"[{}=;\\]\s*$|^\s*[{}\])]|\w\(|\"\s*:|:=|=>|==|^\s*(?:import|from|def|class|func|return|const|let|var|use|require|include|package|pip|npm|go|cargo)\s+\S+\s*(?:$|[({;=])|^\s*(?:at|File)\s+\S+[(:]")
#: Signs of code within a line that ends like code; without any, its words are held against separators and repetition.
SIGNS = re.compile(r"[(){}\[\]=<>\"\\`]|::|->|^\s*(?:import|from|def|class|func|return|const|let|var|use|require|include|package|pip|npm|go|cargo)\s+\S+\s*[({;=]?\s*$")
ROW = re.compile(r"^\s*\|.*\|\s*$")
RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
SENTENCES = re.compile(r"(?<=[.!?؟])\s+|(?<=[。！？])")
SEPARATOR = re.compile(r"[|,;/•·»›→，、；／｜&،؛]|\s[-–—]\s")
COMMA = re.compile("[,;，、；／｜،؛]")
STRONG = re.compile(r"[|•·»›｜]|;\s|\s[-–—/]\s")
WIDE_SEPARATOR = re.compile("(?<=[\\s一-鿿ぁ-ヿ가-힣])[|;/•·；｜／](?=[\\s一-鿿ぁ-ヿ가-힣])")
WIDE_BLANK = re.compile("(?<=[一-鿿ぁ-ヿ])\\s+(?=[一-鿿ぁ-ヿ])")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
STRIP = " \t.,;:!?()[]{}\"'*_~`<>|/\\-–—•·+#，。；：！？（）「」、¿¡،؛؟"


RUN = 24
LINE_ENDS = re.compile("[\\r\\n\x0b\x0c\u2028\u2029]+")


def visible(text: str) -> str:
    return text if text.isascii() else INVISIBLE.sub("", text)


def mass(text: str) -> int:
    """Characters that are no white space; Chinese, Japanese and Korean ones say more and count twice."""
    return len("".join(text.split())) + (0 if text.isascii() else len(WIDE.findall(text)))


def tokens_of(text: str) -> list[str]:
    tokens = [t for x in text.casefold().replace("’", "'").split() if (t := x.strip(STRIP)) and not t[0].isdigit()]
    # Long runs of one or two letters are no words.
    return [t for t in tokens if len(t) < RUN or len(set(t)) > 2] if len(text) > RUN else tokens


def own_words(words: Counter[str]) -> dict[str, frozenset[str]]:
    """The function words of the languages that a page is written in: in each script the one that explains most of its
    tokens, then any that explains a fourth as many of the others by two words at the least."""
    found = [(languages, n) for word, n in words.items() if (languages := LANGUAGES_OF.get(word))]
    own: dict[str, frozenset[str]] = {}
    most: dict[str, int] = {}
    while found:
        counts: dict[str, int] = {}
        kinds: dict[str, int] = {}
        for languages, n in found:
            for language in languages:
                counts[language] = counts.get(language, 0) + n
                kinds[language] = kinds.get(language, 0) + 1
        language = max(counts, key=lambda x: (counts[x], kinds[x], x))
        script = SCRIPT.get(language, "Latin")
        if script in most and (kinds[language] < 2 or counts[language] * 4 < most[script]):
            found = [x for x in found if SCRIPT.get(x[0][0], "Latin") != script]
            continue
        own[language] = WORDS[language]
        most.setdefault(script, counts[language])
        found = [x for x in found if language not in x[0]]
    return own


def repetitive(rest: str, tokens: list[str]) -> bool:
    """Does a segment say the same few words, or without word borders the same few characters, over and over?"""
    if len(tokens) > 8:
        pairs, kinds = len(tokens) - 1, len(set(tokens))
        # There are no fewer kinds of pairs than of words but one.
        if kinds * 4 <= len(tokens) <= 200 or (kinds - 1) * 3 <= pairs and len(set(zip(tokens, tokens[1:]))) * 3 <= pairs:
            return True
    if not rest.isascii() and len(signs := WIDE.findall(rest)) >= 16:
        return len(set(zip(signs, signs[1:]))) * 3 <= len(signs)
    return False


#: A sentence has this part of the function words that its language has in the corpus, within bounds: `FLOOR` is the
#: estimate before any page is seen and weighs as many pages as `ENOUGH`, and none is ever more than `CEILING`.
PART, FLOOR, CEILING, ENOUGH = 0.25, 0.05, 0.12, 50
BOUNDS = {"zh": (0.02, 0.06), "ja": (0.02, 0.06), "ko": (0.1, 0.2)}
#: A page with fewer function words, and a sixth of its words outside ASCII, is of a language that is not known.
FOREIGN = 0.1
MASSES = ("sentence", "link", "tag", "keyword", "other")
#: Repetition of a whole page: words, pairs and lines that it must have to count, and for each share the least and the
#: greatest limit. Half of what is over the language's 99.9th percentile is the limit within these bounds, smoothed as above.
LEAST = {"top_word": 30, "repeated_pairs": 60, "repeated_lines": 12}
OVER = {"top_word": (0.45, 0.7), "repeated_pairs": (0.93, 0.98), "repeated_lines": (0.85, 0.95)}
LOWEST, HIGHEST = ({language: BOUNDS.get(language, (FLOOR, CEILING))[k] for language in (*WORDS, *BOUNDS)} for k in (0, 1))

#: What a segment may be: (language, its share of function words, does it hold together as a sentence otherwise?), and so
#: on for each language of its page. The first language whose least share it has decides.
Reading = list[tuple[str, float, bool]]


def readings(rest: str, tokens: list[str], own: dict[str, frozenset[str]]) -> Reading:
    """How a segment, without its links and tags, reads in the languages of its page; without any, it is no sentence."""
    if repetitive(rest, tokens):
        return []
    if not rest.isascii() and WIDE.search(rest):
        kana, hangul, han = len(KANA.findall(rest)), HANGUL.findall(rest), len(HAN.findall(rest))
        wide = len(WIDE.findall(rest))
        few = len(WIDE_SEPARATOR.findall(rest)) * 8 <= wide and len(COMMA.findall(rest)) * 4 <= wide
        if kana >= 3 and kana * 6 >= han:
            return [("ja", len(JAPANESE.findall(rest)) / wide, few)]
        if len(hangul) >= 2:
            return [("ko", len(KOREAN.findall(rest)) / len(hangul), few and len(COMMA.findall(rest)) * 2 <= len(hangul) + 2)]
        if han >= 4:
            return [("zh", len(CHINESE.findall(rest)) / han, few)]
    if not rest.isascii() and (arabic := ARABIC.findall(rest)) and len(arabic) >= 3:
        if len(SEPARATOR.findall(rest)) * 3 > len(tokens):
            return []
        language = next((x for x in own if SCRIPT.get(x) == "Arabic"), "ar")
        hits = sum(t in WORDS[language] for t in arabic) + (len(ARTICLE.findall(rest)) if language == "ar" else 0)
        return [(language, hits / len(arabic), True)]
    if len(tokens) < 3:
        return []
    out: Reading = []
    for language, words in own.items():
        hits = sum(map(words.__contains__, tokens))
        if hits and hits >= LOWEST.get(language, FLOOR) * len(tokens):
            if rest.isascii():
                commas = rest.count(",") + rest.count(";")
                strong = len(STRONG.findall(rest)) if "|" in rest or ";" in rest or " - " in rest or " / " in rest or "\t" in rest else 0
            else:
                strong, commas = len(STRONG.findall(rest)), len(COMMA.findall(rest))
            piled = strong >= 3 and strong * 4 >= len(tokens) or commas >= 3 and commas * 2 >= len(tokens) and hits * 5 < len(tokens)
            out.append((language, hits / len(tokens), not piled))
    return out


def verdict(reading: Reading) -> bool | None:
    """Is a segment a sentence, whatever the least shares come to within their bounds? None if that is open."""
    seen = set()
    for language, share, whole in reading:
        if share and share >= LOWEST.get(language, FLOOR):
            seen.add(whole)
            if share >= HIGHEST.get(language, CEILING):
                break
    else:
        seen.add(False)
    return seen.pop() if len(seen) == 1 else None


def is_sentence(reading: Reading, least: dict[str, float]) -> bool:
    return next((whole for language, share, whole in reading if share and share >= least.get(language, FLOOR)), False)


#: The shares of top word, repeated word pairs and repeated lines from which words that come twice on a page count as
#: keywords outside its sentences, links, tags and code. Without word borders the words are what stands between blanks and commas, so fewer
#: and longer ones; '' is a page whose language is not known, where sentences stand in that text too.
LIMITS = {"zh": (0.34, 0.6, 0.5), "ja": (0.34, 0.6, 0.5), "ko": (0.25, 0.5, 0.5), "": (0.3, 0.6, 0.6)}
LIMIT, LEAST_WORDS = (0.25, 0.5, 0.5), 12
PIECES = re.compile(r"[\s,;，、；／｜/|•·،؛]+")


def fences(lines: list[str]) -> set[int]:
    """The lines of closed fences. A fence that is never closed hides nothing but itself."""
    found: set[int] = set()
    start = -1
    for k, line in enumerate(lines):
        if FENCE.match(line):
            if start < 0:
                start = k
            else:
                found.update(range(start, k + 1))
                start = -1
    return found | {start} if start >= 0 else found


def tables(lines: list[str]) -> set[int]:
    """The lines of tables: neighbouring `|...|` lines with a `|---|` rule among them. Menus have none."""
    found: set[int] = set()
    block: list[int] = []
    for k, line in enumerate([*lines, "end"]):
        if ROW.match(line):
            block.append(k)
        elif line.strip():
            if any(RULE.match(lines[x]) for x in block):
                found.update(block)
            block = []
    return found


def heap(words: Counter[str], pairs: Counter[tuple[str, str]], lines: Counter[str]) -> tuple[float, float, float]:
    """The shares of the top word, of repeated word pairs and of repeated lines."""
    return (
        max(words.values(), default=0) / max(1, words.total()), sum(n for n in pairs.values() if n > 1) / max(1, pairs.total()),
        sum(n for n in lines.values() if n > 1) / max(1, lines.total()),
    )


def heaped(doubtful: list[tuple[str, list[str], int, int]], own: dict[str, frozenset[str]]) -> bool:
    """Are the segments of a page without grammar over the `LIMITS` of its language in any of the three shares?"""
    words: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    lines: Counter[str] = Counter()
    text = " ".join(rest for rest, *_ in doubtful)
    language = next(iter(own), "")
    if not text.isascii() and (wide := len(WIDE.findall(text))) * 3 >= mass(text):
        hangul, kana = sum(map(len, HANGUL.findall(text))), len(KANA.findall(text))
        language = "ko" if hangul * 2 >= wide else "ja" if kana * 6 >= wide else "zh"
    for rest, tokens, *_ in doubtful:
        if language in ("zh", "ja"):
            tokens = [t for x in PIECES.split(rest.casefold()) if (t := x.strip(STRIP)) and not t[0].isdigit()]
        words.update(tokens)
        pairs.update(zip(tokens, tokens[1:]))
        if tokens:
            lines[" ".join(tokens)] += 1
    return words.total() >= LEAST_WORDS and any(x >= limit for x, limit in zip(heap(words, pairs, lines), LIMITS.get(language, LIMIT), strict=True))


class Page:
    """The segments of a text, read once; `judged` then counts them under any least shares of function words. learned:
    function words of the language that the page is said to be in, if that is none with a list (see `learned_words`)."""

    def __init__(self, text: str, learned: tuple[str, frozenset[str]] | None = None):
        text = visible(text)
        linked, tagged, marked = LINKED.search(text) is not None, "#" in text, "<" in text
        lines = LINE_ENDS.split(text)
        self.other = 0
        raw = []
        hidden = fences(lines) if "```" in text or "~~~" in text else set()
        if "|" in text:
            hidden |= tables(lines)
        self.words: Counter[str] = Counter()
        self.pairs: Counter[tuple[str, str]] = Counter()
        self.lines: Counter[str] = Counter()
        every: list[str] = []
        couples: list[tuple[str, str]] = []
        whole: list[str] = []
        for k, line in enumerate(lines):
            stripped = line.strip()
            if not stripped:
                continue
            if k in hidden or LOG.match(line):
                self.other += mass(line)
                continue
            whole.append(stripped.casefold())
            for segment in SENTENCES.split(line):
                size = mass(segment)
                if not size:
                    continue
                bare, links = LINK.subn(" ", segment) if linked and LINKED.search(segment) else (segment, 0)
                link_mass = size - mass(bare) if links else 0
                rest, tags = TAG.subn(" ", bare) if tagged and "#" in bare else (bare, 0)
                tag_mass = mass(bare) - mass(rest) if tags else 0
                if marked and "<" in rest:
                    rest = MARKUP.sub(" ", rest)
                tokens = tokens_of(rest)
                every += tokens
                couples += zip(tokens, tokens[1:])
                raw.append((segment, rest, tokens, size, links, link_mass, tags, tag_mass))
        self.words.update(every)
        self.pairs.update(couples)
        self.lines.update(whole)
        self.own = own_words(self.words)
        self.language, self.share = self.main_language(text)
        known = self.language in BOUNDS or SCRIPT.get(self.language) in ("Arabic", "Greek")
        outside = 0 if known or self.share >= FOREIGN or text.isascii() else sum(n for word, n in self.words.items() if not word.isascii())
        self.foreign = outside > 0 and outside * 6 >= self.words.total()
        if self.foreign and learned is not None:
            self.own = {learned[0]: learned[1]}
        self.segments: list[tuple[Reading, str, str, list[str], int]] = []
        for segment, rest, tokens, size, links, link_mass, tags, tag_mass in raw:
            reading = readings(rest, tokens, self.own)
            # What is a sentence for certain needs no other name.
            kind = "sentence" if verdict(reading) else self.kind(segment, tokens, size, links, link_mass, tags, tag_mass)
            self.segments.append((reading, kind, rest, tokens, size))

    @staticmethod
    def kind(segment: str, tokens: list[str], size: int, links: int, link_mass: int, tags: int, tag_mass: int) -> str:
        """What a segment is if it is no sentence; '' for what its words tell."""
        if links and (link_mass * 3 >= size or len(tokens) <= 4 * links):
            return "link"
        if tag_mass * 2 >= size and tags > 1:
            return "tag"
        if CODE.search(segment) and (len(tokens) < 4 or SIGNS.search(segment.rstrip().rstrip("{}=;\\"))):
            return "other"
        return ""

    def main_language(self, text: str) -> tuple[str, float]:
        """The language with most function words on the page, and their share, as `readings` takes it: of the Chinese
        characters (zh), of all characters (ja), of the words in its script (ko, ar), else of all words."""
        if not text.isascii():
            kana, hangul, han = len(KANA.findall(text)), HANGUL.findall(text), len(HAN.findall(text))
            if kana + han >= 20 and kana * 6 >= han:
                return "ja", len(JAPANESE.findall(text)) / len(WIDE.findall(text))
            if len(hangul) >= 10 and sum(map(len, hangul)) >= han:
                return "ko", len(KOREAN.findall(text)) / len(hangul)
            if han >= 20:
                return "zh", len(CHINESE.findall(text)) / han
            if len(arabic := ARABIC.findall(text)) >= 10:
                counts = {x: sum(t in WORDS[x] for t in arabic) for x in WORDS if SCRIPT.get(x) == "Arabic"}
                language = max(counts, key=lambda x: (counts[x], x == "ar"))
                return language, (counts[language] + (len(ARTICLE.findall(text)) if language == "ar" else 0)) / len(arabic)
        if not self.own:
            return "", 0.0
        language, words = next(iter(self.own.items()))
        return language, sum(n for word, n in self.words.items() if word in words) / self.words.total()

    def judged(self, least: dict[str, float]) -> dict[str, float]:
        """Shares of the page's characters: in sentences, links, tags, keywords, and other (code, logs, tables, headings).

        Where one of the three shares of repetition of the text outside sentences, links, tags and code is over its
        limit (`LIMITS`), words that come twice are keywords there, else words that come three times. In a language that
        is not known function words come again too, so there pairs of words must, and a segment that ends as a sentence
        may have more commas.
        """
        sums: Counter[str] = Counter(other=self.other)
        doubtful: list[tuple[str, list[str], int, int]] = []
        for reading, kind, rest, tokens, size in self.segments:
            if kind == "sentence" or reading and is_sentence(reading, least):
                sums["sentence"] += size
            elif kind:
                sums[kind] += size
            else:
                doubtful.append((rest, tokens, size, len(SEPARATOR.findall(rest))))
        often = 1 if len(doubtful) > 1 and heaped(doubtful, self.own) else 2
        for rest, tokens, size, separators in doubtful:
            # Words without grammar are keywords if they are divided by separators or come again and again on the page.
            wide = len(WIDE.findall(rest)) if not rest.isascii() else 0
            if self.foreign:
                again, of = sum(self.pairs[x] > often for x in zip(tokens, tokens[1:])), max(1, len(tokens) - 1)
                dense = 3 if rest.rstrip().endswith((".", "!", "?", "…", "।")) else 4
            else:
                again, of, dense = sum(self.words[t] > often for t in tokens), len(tokens), 4
            # Chinese and Japanese have no blanks between words, so a blank there divides like a comma.
            blanks = len(WIDE_BLANK.findall(rest)) if wide >= 8 else 0
            piled = separators >= 3 and separators * dense >= len(tokens) or blanks >= 4 and blanks * 6 >= wide or wide >= 4 and (separators * 6 >= wide or (commas := len(COMMA.findall(rest))) >= 2 and commas * 14 >= wide)
            if piled or repetitive(rest, tokens) or (again and again * 2 >= of):
                sums["keyword"] += size
            else:
                sums["other"] += size
        everything = max(1, sum(sums.values()))
        return {kind: sums[kind] / everything for kind in MASSES}

    def repetition(self) -> dict[str, float]:
        """Of the whole page but code, logs and tables: the share of its most frequent word, and how much of its word pairs
        and of its lines say what was said before. 0 where there are too few to tell."""
        words, pairs = self.words.total(), self.pairs.total()
        # Lines of code come again in code; to look at those that do is enough.
        code = sum(n for line, n in self.lines.items() if n > 1 and CODE.search(line))
        kinds = len(self.lines) - sum(1 for line, n in self.lines.items() if n > 1 and CODE.search(line))
        lines = self.lines.total() - code
        return {
            "top_word": max(self.words.values()) / words if words >= LEAST["top_word"] else 0.0,
            "repeated_pairs": 1 - len(self.pairs) / pairs if pairs >= LEAST["repeated_pairs"] else 0.0,
            "repeated_lines": 1 - kinds / lines if lines >= LEAST["repeated_lines"] else 0.0,
        }


def smoothed(low: float, high: float, estimate: float, pages: int, start: float) -> float:
    """The mean of `start`, counted as `ENOUGH` pages, and of the estimate over the corpus' pages, within bounds: it moves
    with the corpus without a step."""
    return (ENOUGH * start + pages * min(high, max(low, estimate))) / (ENOUGH + pages)


def least_share(language: str, median: float, pages: int) -> float:
    low, high = BOUNDS.get(language, (FLOOR, CEILING))
    return smoothed(low, high, PART * median, pages, low)


def over_limit(name: str, high_share: float, pages: int) -> float:
    """Halfway from what all but the most repetitive pages of a language stay under to 1."""
    low, high = OVER[name]
    return smoothed(low, high, (1 + high_share) / 2, pages, (low + high) / 2)


KINDS = [*MASSES, *OVER]
READ = "key bigint, language string, share double, " + ", ".join(f"{k} double" for k in KINDS) + ", text string, label string, words array<string>"
#: Letters that a learned function word has at the most, and the part of the pages of its language that hold it at the
#: least, ENOUGH pages without it being counted too.
SHORT, SPREAD = 5, 0.2
#: What a language is called, so that there are no more of them than such codes.
CODE_OF_LANGUAGE = re.compile("[a-z]{2,3}")
NO_LABEL = {"", "und", "xx", "mul", "mis", "zxx", "eng", "deu", "ger", "spa", "fra", "fre", "por", "ita", "nld", "dut", "pol", "swe", "tur", "rus", "ell", "gre", "ara", "fas", "per", "urd", "zho", "chi", "jpn", "kor"}


def settled(page: Page, most: float | None) -> tuple[dict[str, float], bool]:
    """The shares of a page, and whether they stand whatever the corpus makes of the least shares of function words; with
    `most` it is enough that links, tags and keywords are surely more than that part of the page or surely not."""
    sure, sure_not, everything, waits = 0, page.other, page.other, False
    for reading, kind, _, _, size in page.segments:
        everything += size
        if kind == "sentence":
            sure_not += size
        elif reading and verdict(reading) is None:
            waits = True
        elif kind == "other":
            sure_not += size
        elif kind:
            sure += size
    if waits and most is not None:
        waits = not (sure > most * everything or everything - sure_not <= most * everything)
    return page.judged(LOWEST), not waits


def stuffing(shares: dict[str, float]) -> float:
    return shares["link"] + shares["tag"] + shares["keyword"]


def label_of(said: str | None) -> str | None:
    """The language that a page is said to be in, if it is one without a list."""
    label = re.split(r"[-_]", (said or "").strip().casefold())[0]
    return label if CODE_OF_LANGUAGE.fullmatch(label) and label not in NO_LABEL and label not in LOWEST else None


def read_pages(documents: DataFrame, key: str, text: str, most: float | None, said: str | None = None) -> DataFrame:
    """READ for every text that is not null or blank: all that is needed of it is found here in one pass. The text itself
    goes on only for a page whose verdict awaits the calibration, or the function words of a language without a list;
    of the latter pages the short words go on too. said: the column with what a page's language is said to be."""
    label = F.lit(None).cast("string") if said is None else F.col(f"`{said}`").cast("string")
    rows = spread(documents.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"), label.alias("said")).filter("text IS NOT NULL"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, v, said in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not visible(v).strip():
                    continue
                page = Page(v)
                shares, sure = settled(page, most)
                again = page.repetition()
                label = label_of(said) if page.foreign else None
                words = None if label is None else sorted(w for w in page.words if len(w) <= SHORT)
                out.append((k, page.language, page.share, *(shares[x] for x in MASSES), *(again[x] for x in OVER), None if sure and label is None else v, label, words))
            columns = list(zip(*out, strict=True)) if out else [()] * (len(KINDS) + 6)
            kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.float64()] * len(KINDS), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["key", "language", "share", *KINDS, "text", "label", "words"])

    return rows.mapInArrow(run, READ)


def learned_words(pages: DataFrame) -> dict[str, frozenset[str]]:
    """Function words of each language without a list, learned from the pages that are said to be in it: short words that
    a part SPREAD of them holds. ENOUGH pages without any are counted too, so a few pages teach nothing and there is no
    step. Starts a job; to the driver come at most the words of 1 / SPREAD pages a language."""
    of = pages.filter("label IS NOT NULL")
    counts = of.groupBy("label").agg(F.count("*").alias("n"))
    df = of.select("label", F.explode("words").alias("word")).groupBy("label", "word").agg(F.count("*").alias("df"))
    kept = df.join(counts, "label").filter(F.col("df") >= SPREAD * (F.col("n") + ENOUGH))
    return {r["label"]: frozenset(r["words"]) for r in kept.groupBy("label").agg(F.collect_list("word").alias("words")).collect()}


def calibrated(pages: DataFrame) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """By language: the least share of function words in a sentence, from the median over all pages; and the limits of
    the shares of repetition, from their high percentiles. '' stands for a language that is not known.

    Starts a job, with one row a language to the driver. Pages of keywords hold few function words and pull a median
    down a little, never up; a quarter of it stays far below real sentences.
    """
    high = [F.percentile_approx(name, 0.999, 1000).alias(name) for name in OVER]
    found = pages.groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("share") > 0).alias("spoken"), F.percentile_approx(F.when(F.col("share") > 0, F.col("share")), 0.5).alias("median"), *high).collect()
    least = {language: least_share(language, 0.0, 0) for language in (*WORDS, *BOUNDS)}
    limits = {language: {name: over_limit(name, 0.0, 0) for name in OVER} for language in (*least, "")}
    for row in found:
        if row["language"]:
            least[row["language"]] = least_share(row["language"], row["median"] or 0.0, row["spoken"])
        limits[row["language"]] = {name: over_limit(name, row[name], row["n"]) for name in OVER}
    return least, limits


def page_features(documents: DataFrame, key: str, text: str, most: float | None = None, said: str | None = None) -> DataFrame:
    """key, the shares KINDS and `over` (is a share of repetition over the limit of the page's language?) for every text
    that is not null or blank. The texts are read once; what was found goes through the checkpoint folder, and pages that
    await the calibration are judged again from there. No shuffle but for calibration.

    most: only whether links, tags and keywords are more than this need be right, so fewer pages wait. said: the column
    with what a page's language is said to be; it only tells which pages teach the words of a language without a list.
    """
    pages = cut(read_pages(documents, key, text, most, said))
    least, limits = calibrated(pages)
    learned = learned_words(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = (batch.column(len(KINDS) + k).to_pylist() for k in (3, 4))
            found = [Page(v, (label, learned[label]) if label in learned else None).judged(least) for v, label in zip(texts, labels, strict=True)]
            columns = [pa.array([x[kind] for x in found], pa.float64()) for kind in MASSES]
            yield pa.record_batch([*batch.columns[:3], *columns, *batch.columns[3 + len(MASSES) :]], batch.schema.names)

    waiting = pages.filter("text IS NOT NULL").mapInArrow(run, READ)
    rows = pages.filter("text IS NULL").unionByName(waiting)
    over = F.lit(False)
    for language, of in limits.items():
        over = F.when(F.col("language") == language, F.greatest(*[F.col(name) - limit for name, limit in of.items()]) > 0).otherwise(over)
    return rows.select(F.col("key").alias(key), *KINDS, over.alias("over"))


def stuffed_pages(documents: DataFrame, key: str, text: str, most: float = 0.5, said: str | None = None) -> DataFrame:
    """The rows of `page_features` of pages with more than `most` of their characters in links, tags and keywords outside
    sentences, or with a share of repetition over the limit of their language. Null, empty and blank texts are no page;
    code, logs and tables count as other text."""
    return page_features(documents, key, text, most, said).filter((F.col("link") + F.col("tag") + F.col("keyword") > most) | F.col("over"))
