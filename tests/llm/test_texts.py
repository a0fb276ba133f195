"""Operators on texts: the tokenizer against two public libraries, leaks and keywords against small cases."""

import pickle
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from billow.llm import bpe, canon, leaks, spam

ODD = ["", " ", "\n\n  \t", "a", "<|endoftext|>", "naïve café", "中文 문장 текст", "👩‍💻🚀", "x" * 3000, "a  b   c\r\n", "\x00\x07‮", "don't WE'LL", "0123456789 " * 20, "=" * 500, "​­", "ﬁ Ａ"]


@pytest.fixture(scope="module")
def machine():
    pytest.importorskip("public_tokenizers")
    return bpe.transducer(bpe.vocabulary(None))


def test_ids_as_libraries_give_them(machine):
    tokenizers, tiktoken = pytest.importorskip("tokenizers"), pytest.importorskip("tiktoken")
    import public_tokenizers as P

    first = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=machine.ranks, special_tokens={})
    rnd = random.Random(7)
    texts = ODD + ["".join(chr(rnd.choice([rnd.randint(9, 126), rnd.randint(0xA0, 0x24F), rnd.randint(0x3040, 0x9FFF), rnd.randint(0x1F300, 0x1F700)])) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    for text in texts:
        ids = machine.encode(text)
        assert ids == first.encode(text, add_special_tokens=False).ids == second.encode_ordinary(text), text
        assert bpe.decode(machine.bytes_of[i] for i in ids) == text


def test_states_stay_within_their_limit_inside_a_piece(machine, monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    machine.reset()
    want = machine.encode(text)
    monkeypatch.setattr(bpe, "STATE_LIMIT", 200)
    machine.reset()
    assert machine.encode(text) == want and len(machine.states) <= 202


def test_output_waits_for_bounded_lookahead(machine):
    state, waiting = machine.start, 0
    for byte in b"antidisestablishmentarianism" * 20:
        emitted, state = state.next.get(byte) or machine.step(state, byte)
        waiting = max(waiting, max(len(p) for p, _, _ in state.items))
        assert sum(node == 0 for _, _, node in state.items) == 1
    assert waiting < 40


@pytest.mark.parametrize("data", [b"\xff", b"\xe2\x82", b"\xf0\x9f\x98\x80", b"\xed\xa0\x80", b"a\xc3", b"\xc0\xaf", b"\xf4\x90\x80\x80", "é中😀".encode()])
def test_utf8_machine_as_python(data):
    for step in (1, 2, len(data)):
        assert bpe.decode(data[i : i + step] for i in range(0, len(data), step)) == data.decode("utf-8", "replace")


@pytest.mark.parametrize("out", [1, 1_000_000])
def test_encode_texts(spark, machine, monkeypatch, out):
    monkeypatch.setattr(bpe, "OUT", out)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None])], "doc_id bigint, text string, ids string")
    out = {r.doc_id: r.ids for r in bpe.encode_texts(df, "doc_id", "text").collect()}
    assert len(out) == len(ODD) + 1 and out[0] == [] and out[len(ODD)] == [] and out[4] == machine.encode("<|endoftext|>")
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_texts(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert [back[i] for i in range(len(ODD))] == ODD
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


PASSAGE = "The quick brown fox jumps over the lazy dog while seven grey wolves watch from the old stone bridge near Velora"


@pytest.mark.parametrize("limit", [20_000, 1])
def test_leaks(spark, monkeypatch, limit):
    monkeypatch.setattr(leaks, "ITEM_LIMIT", limit)
    words = PASSAGE.split()
    docs = {
        1: "Intro text. " + PASSAGE + " and more",
        2: "x " * 500 + " ".join(words[5:17]) + " y" * 500,  # twelve words, far inside
        3: " ".join(words[5:16]),  # eleven
        4: " ".join(words[:6] + ["inserted"] + words[6:12]),
        5: PASSAGE.upper().replace(" ", " \r\n\t").replace("O", "o​­"),
        6: " ".join(reversed(words)),
        7: None,
        8: "",
        9: "   ",
        10: "What is the question here exactly " + PASSAGE.replace(" ", ", ") + " forty two",
        11: " ".join(words[:12] + words[12:20]),
        12: " ".join(words[:12] + words[8:20]),  # two runs, the second one begins in the middle of the first
    }
    items = [(1, PASSAGE, "question here", "forty two"), (2, "too short a passage", "q", "a"), (3, None, None, None), (4, PASSAGE, "", None), (None, PASSAGE, "q", "a")]
    d = spark.createDataFrame([(k, v, 0) for k, v in docs.items()], "doc_id bigint, text string, item int")
    i = spark.createDataFrame(items, "item_id bigint, passage string, question string, answer string")
    out = leaks.leaks(d, "doc_id", "text", i, "item_id", "passage", "question", "answer").collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == sorted((k, x) for k in (1, 2, 5, 10, 11, 12) for x in (1, 4))
    by = {(r.doc_id, r.item_id): r for r in out}
    assert by[10, 1].question and by[10, 1].answer and not by[1, 1].question and not by[10, 4].question
    assert by[2, 1].words == 12 and by[1, 1].words == len(words) and by[11, 1].words == 20 and by[12, 1].words == 12
    assert leaks.leaks(d, "doc_id", "text", i.limit(0), "item_id", "passage", "question", "answer").count() == 0
    assert leaks.leaks(d.limit(0), "doc_id", "text", i, "item_id", "passage", "question", "answer").count() == 0


def test_retrieval_loses_nothing():
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)]  # few words, so chance scores are high
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 90))), "", "") for k in range(70)]
    index = leaks.Index(items, 12)
    texts = []
    for _ in range(200):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 150))]
        source = items[rnd.randrange(70)][1].split()
        start, length = rnd.randrange(max(1, len(source) - 8)), rnd.randint(8, 30)
        at = rnd.randrange(len(words) + 1)
        texts.append(words[:at] + source[start : start + length] + words[at:])
    import numpy as np

    ids = [np.array([index.ids.get(w, -1) for w in t], np.int64) for t in texts]
    got = {(t, int(index.items[k])) for t, k in index.retrieve(ids) if index.longest(ids[t], k)}
    want = {(t, k) for t, words in enumerate(texts) for k, p, _, _ in items if any(" ".join(words[i : i + 12]) + " " in p + " " and f" {' '.join(words[i:i + 12])} " in f" {p} " for i in range(len(words) - 11))}
    assert got == want and want
    for t, words in enumerate(texts[:80]):  # the longest run, by trying all
        joined = [f" {p} " for _, p, _, _ in items]
        for k, x in enumerate(index.items.tolist()):
            best = max((n for i in range(len(words)) for n in range(12, len(words) - i + 1) if f" {' '.join(words[i : i + n])} " in joined[x]), default=0)
            assert index.longest(ids[t], k) == best


@pytest.mark.parametrize("block", [1, 3, 64])
def test_walk_finds_all_that_score_one(monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK", block)
    rnd = random.Random(block)
    items = [(k, " ".join(f"w{min(int(rnd.expovariate(0.2)), 40)}" for _ in range(rnd.randint(12, 60))), "", "") for k in range(300)]
    index = leaks.Index(items, 12)
    for _ in range(150):
        terms = sorted(rnd.sample(range(len(index.keys)), rnd.randint(1, min(31, len(index.keys)))))
        scores = {}
        for t in terms:
            for k in range(index.offsets[t], index.offsets[t + 1]):
                scores[int(index.post_item[k])] = scores.get(int(index.post_item[k]), 0.0) + float(index.post_impact[k])
        assert sorted(index.walk(terms)) == sorted(k for k, x in scores.items() if x >= 1)


def test_index_grows_with_the_words_of_its_items():
    import tracemalloc

    rnd, sizes = random.Random(4), []
    for n in (500, 2000):
        items = [(k, " ".join(f"w{rnd.randrange(30_000)}" for _ in range(100)), "q", "a") for k in range(n)]
        tracemalloc.start()
        index = leaks.Index(items, 12)
        sizes.append(tracemalloc.get_traced_memory()[0])
        tracemalloc.stop()
        assert len(index.post_item) <= 99 * n
    assert sizes[1] < 5 * sizes[0] and sizes[1] < 20e6


def test_weighted_distance():
    assert canon.damerau("license", "lisence", 2) == 2 and canon.damerau("later", "ltaer", 2) == 1 and canon.damerau("abc", "xyz", 1) == 2
    assert canon.weighted_damerau("ab", "ba") == 0.7 and canon.weighted_damerau("xell", "well") > canon.weighted_damerau("wexl", "well")
    words = ["public", "license", "general", "only", "later", "quillon", "harborough"]
    index = canon.SymmetricDelete(dict.fromkeys(words, 0))
    rnd = random.Random(1)
    for word in words:
        for _ in range(60):
            other = list(word)
            for _ in range(canon.edit_bound(len(word))):
                k = rnd.randrange(len(other))
                other[k : k + 1] = rnd.choice([[], [rnd.choice("abc")], [other[k], "x"]]) or ["q"]
            assert word in [x[2] for x in index.lookup("".join(other))] or canon.damerau("".join(other), word, 3) > canon.edit_bound(len(word))


LIST = [("TarnPL-2.0", "Tarnwick Public License 2.0"), ("TarnPL-3.0", "Tarnwick Public License 3.0"), ("Quill-3-Clause", "Quillon 3-Clause License"), ("Quill-2-Clause", "Quillon 2-Clause License"), ("ZGPL-1.0-only", "Zemfira General Public License v1.0 only"), ("ZGPL-1.0-or-later", "Zemfira General Public License v1.0 or later"), ("WolfPL-1.0", "Wolfram Bay Permissive License 1.0")]


@pytest.mark.parametrize(
    ("value", "keys"),
    [
        ("tarnpl 2", ["TarnPL-2.0"]), ("The Tarnwcik Public Lisence, Version 3.0", ["TarnPL-3.0"]), ("Tarnwick Public License 9.0", []), ("TarnwickPublicLicense-2.0", ["TarnPL-2.0"]),
        ("Quillon License (3 clause)", ["Quill-3-Clause"]), ('"Two Clause" Quillon license', ["Quill-2-Clause"]), ("Quillon 4-Clause", []), ("ZGPLv1+", ["ZGPL-1.0-or-later"]),
        ("Zemfira GPL 1.0 or any later version", ["ZGPL-1.0-or-later"]), ("zgpl v1-only", ["ZGPL-1.0-only"]), ("(TarnPL-2.0 OR ZGPL-1.0-only)", ["TarnPL-2.0", "ZGPL-1.0-only"]),
        ("Quill-3-Clause / TarnPL-3.0", ["Quill-3-Clause", "TarnPL-3.0"]), ("https://x.example/l/tarnpl-2.0.html", ["TarnPL-2.0"]), ("wolfram bya permissve license 1.0", ["WolfPL-1.0"]),
        ("TarnPL‑2.0 ", ["TarnPL-2.0"]), ("Proprietary", []), ("Whirligig Trial Agreement v2", []), ("-", []), ("License", []), ("TarnPL-2.0 - Tarnwick Public License 2.0", ["TarnPL-2.0"]),
        ("License, Tarnwick, ver. 3", ["TarnPL-3.0"]), ("z" * 5000, []),
    ],
)
def test_licence_names(value, keys):
    assert canon.Matcher(LIST).match(value) == keys


@pytest.mark.parametrize("seed", range(2))
def test_one_wrong_letter(data, seed):
    """Each name of the test list with one letter changed, left out, put in or swapped, in its longest word."""
    import pyarrow.parquet as pq

    entries = [(r["license_id"], r["full_name"]) for r in pq.read_table(f"{data}/license_list.parquet").to_pylist()]
    matcher, rnd, wrong = pickle.loads(pickle.dumps(canon.Matcher(entries))), random.Random(seed), []
    for key, name in entries:
        word = max(re.findall(r"[A-Za-z]+", name), key=len)
        at = rnd.randrange(1, len(word) - 1)
        letter = rnd.choice("abcdefghijklmnopqrstuvwxyz")
        other = rnd.choice([word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + word[at + 1] + word[at] + word[at + 2 :]])
        if matcher.match(name.replace(word, other, 1)) != [key]:
            wrong.append((name, other))
    assert len(wrong) * 50 <= len(entries), wrong


def test_canonical(spark):
    entries = spark.createDataFrame([*[(k, n, False) for k, n in LIST], (None, "x", True)], "license_id string, full_name string, raw_value boolean")
    values = spark.createDataFrame([("tarnpl 2",), ("tarnpl 2",), (None,), (" ",), ("TarnPL-2.0",), ("?",)], "value string")
    counted = canon.counted_values(values, "value")
    free = canon.free_values(counted, entries, "license_id", "full_name")
    assert rows(free) == [("?", 1), ("tarnpl 2", 2)]
    assert rows(canon.canonical(free, "value", entries, "license_id", "full_name", counted)) == [("?", ""), ("tarnpl 2", "TarnPL-2.0")]
    assert rows(canon.canonical(free, "value", entries.limit(0), "license_id", "full_name")) == [("?", ""), ("tarnpl 2", "")]
    assert canon.canonical(free.limit(0), "value", entries, "license_id", "full_name").count() == 0


SENTENCES = "The exporter sorts components so that two exports can be compared line by line. Each component carries a name and a version. Most users will never need the flag, but it helps when a registry is slow. "
PAGES = {
    1: (SENTENCES * 3, False),
    2: ("# Title\n" + "\n".join(f"[pkg{i}](https://x.example/{i})" for i in range(40)), True),
    3: (SENTENCES[:80] + "\n\n" + " ".join(f"#free{i} #best" for i in range(60)), True),
    4: ("cheap docker image | best cloud | free license | cheap docker | best cloud image | " * 10, True),
    5: ("\n".join(["sbom java eastvale", "sbom java old mill", "sbom java lakeside tool"] * 12), True),
    6: ("免费下载|最新版|插件|优惠|开源项目|云服务|许可证|安全审计|" * 8, True),
    7: ("感谢所有参与测试的贡献者。从 1.3.9 版本开始，扫描结果会按名称排序。如果缺少 go.mod，请先运行安装命令。" * 4, False),
    8: ("```go\nfunc main() {\n  x := load(\"a\")\n  x := load(\"a\")\n}\n```\n" * 10, False),
    9: ("\n".join(f"2025-01-0{i}T02:10:00Z WARN proxy: cache not found" for i in range(1, 9)), False),
    10: ("| component | version | licence |\n|---|---|---|\n" + "| a | 1.0 | MIT |\n" * 30, False),
    11: ("## 1.2.3\n" + "- Fixed a crash when the scanner appears twice with different casing.\n" * 10, False),
    12: (SENTENCES * 2 + "\n\nLinks: https://a.example/1 https://a.example/2\n#report #free #cheap", False),
    13: ("Image best plugin trial best fix fix. Image fix plugin trial fix cloud. Cloud plugin trial image tool trial key. " * 6, True),
    14: ("Home | Worker | Proxy | Shell | Forms | Lexer | Logger | Cache | Codec | Render", True),
    15: ("   \n", False),
    16: ("", False),
    17: (None, False),
    18: ("Die Lizenzangabe von proxy ist leider unvollständig. Ab Version 2.1 wird der Cache nur noch bei Bedarf geladen. " * 4, False),
}


def test_stuffed_pages(spark):
    df = spark.createDataFrame([(k, t, 1.0) for k, (t, _) in PAGES.items()], "doc_id bigint, text string, link double")
    assert [r.doc_id for r in spam.stuffed_pages(df, "doc_id", "text").orderBy("doc_id").collect()] == [k for k, (_, bad) in PAGES.items() if bad]
    assert spam.page_features(df, "doc_id", "text").count() == len(PAGES) - 3
    assert spam.stuffed_pages(df.limit(0), "doc_id", "text").count() == 0


#: Nouns that a test by endings or by letters alone takes for sentences, with sentences of the same languages.
PILES = {
    0: ("برنامج مجاني، تحميل سريع، أفضل أداة، رخصة رخيصة، خادم سحابي، إضافة جديدة\n" * 2, True),
    1: ("無料のダウンロード、おすすめのツール、ライセンスの比較\n" * 20, True),
    2: ("최저가 광고 언어 최저가 무료 광고 언어 추천 최저가 다운로드 " * 30, True),
    3: ("برنامج مجاني " * 1000, True),
    4: ("免费的下载 最新的插件 " * 60, True),
    5: ("the free tool of the best " * 80, True),
    6: ("無料のダウンロード、おすすめのツール、ライセンスの比較、人気のプラグイン\n最新のソフト、格安のサーバー、便利なアプリ\n", True),
    7: ("このツールは依存関係の一覧を作成します。ライセンスの表記は統一されていません。空の結果を返します。" * 5, False),
    8: ("이 도구는 의존성 목록을 만듭니다. 라이선스 표기는 통일되어 있지 않습니다. 파일이 없으면 빈 결과를 반환합니다. " * 5, False),
    9: ("تقرأ الحزمة الملف وتنتج قائمة مرتبة. لا يمكن تحميل الملف من الخادم في هذه الحالة. " * 5, False),
    10: ("این بسته فایل را می خواند و فهرست را تولید می کند. " * 5 + "\n" + SENTENCES, False),
    11: (SENTENCES * 2 + "\nVoir https://a.example/9 pour la liste complète des composants et des versions.\nПакет читает файл и строит список компонентов из него.", False),
}


def test_piles_are_no_sentences(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in PILES.items()], "doc_id bigint, text string")
    assert [r.doc_id for r in spam.stuffed_pages(df, "doc_id", "text").orderBy("doc_id").collect()] == [k for k, (_, bad) in PILES.items() if bad]


def test_function_words_of_another_language_count_for_nothing():
    least = dict.fromkeys([*spam.WORDS, "zh", "ja", "ko"], spam.FLOOR)
    text = SENTENCES + "\n" + "\n".join(f"die cloud image{i} plan{i}" for i in range(3))
    assert spam.Page(text).judged(least)["sentence"] < 0.9


TWICE = "docker image cheap\ncloud plan deal\nlicence key rebate\nserver trial offer\nbackup coupon sale\nmailer theme bargain\n"


def test_shares_of_text_without_grammar_decide():
    least = dict.fromkeys([*spam.WORDS, "zh", "ja", "ko"], spam.FLOOR)
    stuffed = lambda text: (x := spam.Page(text).judged(least))["link"] + x["tag"] + x["keyword"] > 0.5
    assert stuffed(TWICE * 2) and stuffed(TWICE.replace("\n", " gratis\n", 2) * 2) and stuffed("无痕浏览\n云端备份\n安全审计\n软件清单\n依赖扫描\n开源项目\n" * 2)
    assert not stuffed(TWICE) and not stuffed("# Install\n" * 2 + SENTENCES * 2 + TWICE[:50])
    assert not stuffed("Paketti lukee tiedoston ja kirjoittaa luettelon. Uusi versio julkaistaan keväällä. Virhe korjattiin eilen illalla. Kiitos kaikille testaajille avusta.")


def test_calibration_has_no_step_and_knows_all_languages(spark):
    steps = [spam.least_share("en", 0.4, n) for n in range(200)]
    assert steps[0] == spam.FLOOR and max(b - a for a, b in zip(steps, steps[1:])) < 0.003 and steps == sorted(steps)
    assert spam.least_share("en", 0.4, 10**7) > 0.0999 and spam.least_share("en", 0.9, 10**7) <= spam.CEILING
    pages = [PILES[k][0] for k in (7, 8, 9, 10)] + [PAGES[7][0], SENTENCES]
    pages[3] = pages[3].split("\n")[0]
    assert [spam.Page(text).language for text in pages] == ["ja", "ko", "ar", "fa", "zh", "en"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(pages * 20)], "doc_id bigint, text string")
    least, floor = (spam.calibrated(spam.read_pages(x, "doc_id", "text", None))[0] for x in (df, df.limit(0)))
    assert all(least[x] > floor[x] for x in ("ja", "ko", "ar", "fa", "zh", "en")) and least["sv"] == floor["sv"]


HIDDEN = {
    1: ("| Home | Docs | Pricing |\n| Blog | Shop | Login |\n| Cloud | Deals | Themes |\n", True),
    2: ("cheap licence; free sbom; best tool;\nbest cloud; cheap image; free plan;\n", True),
    3: ("```\n" + PAGES[4][0], True),
    4: ("| a | b |\n|:--|---|\n" + "| Home | Docs |\n" * 20, False),
    5: ("```sh\nx | y | z | a | b\n```\n" * 10 + "~~~\ncheap | best | free | tool\n~~~\n", False),
    6: ("int alpha = load(a, b, c);\nreturn alpha;\nuse std::io;\nbreak;\n" * 8, False),
    7: (SENTENCES + "\n```\n" + SENTENCES, False),
}


def test_tables_fences_and_code_hide_no_keywords(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in HIDDEN.items()], "doc_id bigint, text string")
    assert [r.doc_id for r in spam.stuffed_pages(df, "doc_id", "text").orderBy("doc_id").collect()] == [k for k, (_, bad) in HIDDEN.items() if bad]


PROSE = {
    "cs": "Nástroj prochází všechny soubory projektu, porovnává je s předchozím stavem a zapisuje rozdíly do zprávy. Pokud se některý balíček změnil, uživatel dostane upozornění, které obsahuje název, verzi a licenci. Zpráva se ukládá do složky, kterou lze změnit v nastavení.",
    "fi": "Työkalu lukee kaikki projektin tiedostot, vertaa niitä edelliseen tilaan ja kirjoittaa erot raporttiin. Jos jokin paketti on muuttunut, käyttäjä saa ilmoituksen, joka sisältää nimen, version ja lisenssin. Raportti tallennetaan kansioon, jonka voi vaihtaa asetuksista.",
    "vi": "Công cụ đọc tất cả các tệp của dự án, so sánh chúng với trạng thái trước đó và ghi sự khác biệt vào báo cáo. Nếu một gói đã thay đổi, người dùng sẽ nhận được thông báo có tên, phiên bản và giấy phép. Báo cáo được lưu trong thư mục mà bạn có thể thay đổi trong phần cài đặt.",
    "uk": "Інструмент читає всі файли проєкту, порівнює їх із попереднім станом і записує відмінності до звіту. Якщо якийсь пакунок змінився, користувач отримує повідомлення, яке містить назву, версію та ліцензію.",
}
PILED = {
    "equal lines": "\n".join(["buy cheap parser library now the best of all"] * 200),
    "cs": "levný software, nejlepší nástroj, stáhnout zdarma, sbom generátor, licence levně, open source nástroj, " * 4,
    "fi": "Halpa ohjelmisto paras työkalu lataa ilmaiseksi. Lisenssi halvalla sbom generaattori paras hinta. Lataa ilmainen ohjelmisto paras työkalu halpa lisenssi. " * 3,
    "zh": "云服务 报价 优惠 许可证 软件清单 工具 免费下载 最新版 依赖扫描 插件",
}


def test_languages_that_are_not_known(spark):
    pages = [*PROSE.values(), *PILED.values()]
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id bigint, text string")
    assert [r.doc_id for r in spam.stuffed_pages(df, "doc_id", "text").orderBy("doc_id").collect()] == list(range(len(PROSE), len(pages)))


def test_open_verdicts_are_settled_by_the_calibration(spark):
    """Pages that are read once and judged later get what they get when the least shares are known from the start."""
    rnd = random.Random(5)
    common, rare = "the of and to in".split(), [f"w{i}" for i in range(400)]
    pages = ["\n".join(" ".join(rnd.choice(common) if rnd.random() < share else rnd.choice(rare) for _ in range(14)) + "." for _ in range(9)) for share in (0.03, 0.07, 0.09, 0.12, 0.4) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id bigint, text string")
    for most in (None, 0.5):
        kept = spam.read_pages(df, "doc_id", "text", most)
        least, _ = spam.calibrated(kept)
        assert kept.filter("text IS NOT NULL").count() > 0 or most
        got = {r.doc_id: r for r in spam.page_features(df, "doc_id", "text", most).collect()}
        for k, text in enumerate(pages):
            want = spam.Page(text).judged(least)
            if most is None:
                assert {x: got[k][x] for x in spam.MASSES} == want
            assert (got[k].link + got[k].tag + got[k].keyword > 0.5) == (spam.stuffing(want) > 0.5)


def test_limits_move_without_a_step():
    for name, (low, high) in spam.OVER.items():
        steps = [spam.over_limit(name, 0.2, n) for n in range(300)]
        assert steps[0] == pytest.approx((low + high) / 2) and max(abs(b - a) for a, b in zip(steps, steps[1:])) < 0.01 and low - 1e-9 <= min(steps)


def test_a_long_list_is_joined_with_the_same_result(spark, data, monkeypatch):
    import pyarrow.parquet as pq

    from billow.llm.queries import typed_licenses

    entries = [(r["license_id"], r["full_name"]) for r in pq.read_table(f"{data}/license_list.parquet").to_pylist()] + LIST
    typed = sorted({r.value for r in typed_licenses(spark, data).collect()})
    odd = ["tarnpl 2", "TarnwickPublicLicense-2.0", "zgpl v1-only", "License", "", "-", "z" * 400, "Quillon 4-Clause", "https://x.example/l/tarnpl-2.0.html", "ZemfiraGeneralPublicLicnse 1.0+"]
    df = spark.createDataFrame([(k, n) for k, n in entries] + [(None, "x")], "license_id string, full_name string")
    values = spark.createDataFrame([(v,) for v in [*typed, *odd, None]], "value string")
    counts = values.filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    whole = rows(canon.canonical(values, "value", df, "license_id", "full_name", counts))
    monkeypatch.setattr(canon, "LIST_LIMIT", 5)
    assert rows(canon.canonical(values, "value", df, "license_id", "full_name", counts)) == whole
    assert len({v for v, e in whole if e}) > 20


def test_function_words_of_a_language_without_a_list_are_learned(spark):
    """Made-up language: short words between long ones in sentences; keyword pages have only long ones."""
    rnd = random.Random(8)
    short, long = ["ŋa", "šo", "vę", "ků"], [f"{a}{b}ťák" for a in ("mor", "bel", "tuk", "ran", "sil", "pod") for b in ("oz", "ir", "uk", "en", "av", "yl", "om")]
    sentence = lambda: " ".join(rnd.choice(short) if k % 3 == 1 else rnd.choice(long) for k in range(11)).capitalize() + "."
    pages = [(" ".join(sentence() for _ in range(12)), "qx-XX") for _ in range(80)] + [(", ".join(rnd.choice(long) for _ in range(60)), "QX") for _ in range(5)]
    df = spark.createDataFrame([(k, t, said) for k, (t, said) in enumerate(pages)], "doc_id bigint, text string, lang string")
    kept = spam.read_pages(df, "doc_id", "text", 0.5, "lang")
    assert spam.learned_words(kept) == {"qx": frozenset(short)} and spam.learned_words(kept.limit(5)) == {}
    found = spam.page_features(df, "doc_id", "text", said="lang").orderBy("doc_id").collect()
    assert all(r.sentence > 0.9 for r in found[:80]) and all(r.keyword > 0.9 for r in found[80:])
    assert [r.doc_id for r in spam.stuffed_pages(df, "doc_id", "text", said="lang").orderBy("doc_id").collect()] == list(range(80, 85))
    assert spam.label_of(None) is spam.label_of("en-US") is spam.label_of("ENG") is spam.label_of(" ") is None and spam.label_of("cs_CZ") == "cs"
    assert spam.label_of("some long text") is spam.label_of("x") is None


def test_letter_runs_and_links_beside_wide_text_are_no_case(spark):
    pages = [
        "## 0.0.7\n\n" + "x" * 300 + "\n\n" + SENTENCES + "\n\n" + "x" * 300 + "\n\n* " + SENTENCES[:80] + ".\n\n" + "x" * 300,
        "# Tarnuma\n\nライセンスの表記は統一されていません。9 件のリポジトリで動作を確認しました。\n\n## 使い方\n\n268 件のリポジトリで動作を確認しました。\n\nLinks: https://velorb.example/router/24 https://caldack.example/cr/7 https://nexard.example/map/2",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id bigint, text string")
    assert spam.stuffed_pages(df, "doc_id", "text").count() == 0
