"""Text operators: words, leaks, packing, stuffed pages."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliograph.llm import leaks, packing, stuffing
from heliograph.llm.words import words, words_in_place

DOCS = "doc_id bigint, text string, item_id string"


def test_words():
    assert words("The<em>re</em> <p>A&nbsp;B&amp;C</p> in­vis​ible, ÉTÉ 3.5 a < b") == ["there", "a", "b", "c", "invisible", "été", "3", "5", "a", "b"]
    assert words(None) == [] and words("") == [] and words("<script>x y</script>z<!-- q -->") == ["z"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "e\u0301", "ﬁ", "İ", "ß", " ", "<p>", "</em>", "<em>", "&amp;", "&nbsp;", "&lt;b&gt;", "\u200b", "\u00ad", "3", ".", "-", "\u1100\u1161", "<!-- x -->", "½"]), max_size=25))
def test_words_in_place(parts):
    text = "".join(parts)
    placed = words_in_place(text)
    assert [w for w, _, _ in placed] == words(text)
    assert all(0 <= a < b <= len(text) for _, a, b in placed) and all(x[1] <= y[1] and x[2] <= y[2] for x, y in zip(placed, placed[1:], strict=False))


def test_strip_cuts_passages_of_several_items_once(spark):
    docs = spark.createDataFrame([(1, "a b <b>c</b> d&amp;e f g h", 5), (2, "a b c d", 6), (3, None, 7)], "doc_id bigint, text string, spans int")
    spans = leaks.leak_spans(docs, spark.createDataFrame([(1, "b c d"), (2, "c d e"), (3, "a b c d")], "item_id bigint, text string"), 3)
    assert sorted((r["doc_id"], r["item_id"], r["spans"], r["covered"]) for r in spans.collect()) == [(1, 1, [1, 3], 3), (1, 2, [2, 4], 3), (1, 3, [0, 3], 4), (2, 1, [1, 3], 3), (2, 3, [0, 3], 4)]
    assert sorted(map(tuple, leaks.strip_leaks(docs, spans, 3, 0.7).collect())) == [(1, " f g h", 5), (3, None, 7)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5))
def test_automaton(items, text, least):
    automaton = leaks.SuffixAutomaton(list(enumerate(items)), least)
    inside = lambda part, item: any(item[k : k + len(part)] == part for k in range(len(item) - len(part) + 1))
    got = {end: (length, set(owners)) for end, length, owners in automaton.matches(text)}
    for end in range(len(text)):
        longest = max((n for n in range(1, end + 2) if any(inside(text[end + 1 - n : end + 1], item) for item in items)), default=0)
        if longest >= least:
            assert got[end] == (longest, {k for k, item in enumerate(items) if inside(text[end + 1 - least : end + 1], item)})
        else:
            assert end not in got


def test_leaks(spark, monkeypatch):
    rng = random.Random(7)
    item = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(30))
    items = [(k, item()) for k in range(20)] + [(98, None), (99, "too short"), (97, "")]
    shared = items[0][1].split()[:15]
    items.append((50, "x y " + " ".join(shared)))
    text = items[3][1].split()
    docs = [
        (1, "pre " + " ".join(text[5:18]) + " post"), (2, " ".join(text[5:17])), (3, " ".join(shared)), (4, None), (5, ""), (6, "<p>" + "&nbsp;".join(f"{w.upper()},​" for w in text) + "</p>"),
        (7, "z " * 300_000 + " ".join(text)), (None, " ".join(text)), (1, "pre " + " ".join(text[5:18]) + " post"),
    ]
    df = spark.createDataFrame([(a, b, "clash") for a, b in docs], DOCS)
    expected = [(1, 3), (3, 0), (3, 50), (6, 3), (7, 3)]
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()) == expected
    monkeypatch.setattr(leaks, "AUTOMATON_WORDS", 150)  # several groups, read one after the other
    items = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, items).collect()) == expected
    left = sorted((r["doc_id"] or 0, r["text"], r["item_id"]) for r in leaks.strip_leaks(df, leaks.leak_spans(df, items), most_covered=0.9).where("text IS NOT NULL").collect())
    texts = {k: t for k, t in docs}
    assert left == [(0, texts[None], "clash"), *[(1, "pre  post", "clash")] * 2, (2, texts[2], "clash"), (5, "", "clash"), (7, "z " * 300_000, "clash")]
    none = spark.createDataFrame([], DOCS)
    assert leaks.find_leaks(none, none.selectExpr("doc_id AS item_id", "text")).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 50)), max_size=25))
def test_plan_places_everything(counts):
    histogram = np.zeros(65, np.int64)
    for length, n in counts:
        histogram[length] += n
    placed = np.zeros(65, np.int64)
    for pattern, repeats in packing.plan(histogram, 64):
        assert sum(length * n for length, n in pattern) <= 64 and repeats > 0
        for length, n in pattern:
            placed[length] += n * repeats
    assert (placed == histogram).all()


def test_packing(spark):
    rng = random.Random(8)
    lengths = [(k, rng.choice([0, 1, 700, 700, 700, rng.randrange(1, 2048), rng.randrange(2048, 9000), 2048, 4096])) for k in range(1500)]
    rows = packing.pack(spark.createDataFrame(lengths, "doc_id bigint, tokens bigint")).collect()
    used, pieces = {}, {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
    assert max(used.values()) <= 2048
    for doc, tokens in lengths:
        own = sorted(pieces[doc])
        assert [p for p, _ in own] == list(range(max(1, -(-tokens // 2048)))) and sum(t for _, t in own) == tokens
        assert all(t == 2048 for _, t in own[:-1])
    room: list[int] = []  # best fit decreasing over single items
    for t in sorted((t for own in pieces.values() for _, t in own if t), reverse=True):
        fits = [k for k, left in enumerate(room) if left >= t]
        if fits:
            room[min(fits, key=room.__getitem__)] -= t
        else:
            room.append(2048 - t)
    assert len([c for c, n in used.items() if n]) <= 1.01 * len(room) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint")).count() == 0


def test_rank_parts_do_not_change_a_plan(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_PART", 40)
    rows = packing.pack(spark.createDataFrame([(k, 500) for k in range(400)], "doc_id bigint, tokens bigint")).collect()
    used = {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + 1
    assert sorted(used.values()) == [4] * 100


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 200_000, "x"), (4, "a", "x"), (None, "b", "x")], DOCS)
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000 and len(got) == 4


PROSE = "On the back of the print someone had written a date, and we walked past the harbour before the light was gone."
SPAM = {
    "phrase": "best memory card! best memory card, best memory card. " * 8,
    "filler": "Ask lens filter sale about cheap camera lens, lens filter sale or lens filter sale. Our lens filter sale, your lens filter sale: cheap camera lens or lens filter sale! " * 4,
    "soup": "price online camera price 2020 drone online price camera price drone online camera 2021 price online drone camera price online " * 4,
    "links": "\n".join(f"photo book deals : https://www.shop{k}.test/a/{k}" for k in range(9)),
    "anchors": " • ".join(f'<a href="http://x{k}.test/">tripod discount</a>' for k in range(9)),
    "markdown": "\n".join(f"[zoom](http://shop{k}.example/v/{k})" for k in range(9)),
    "products": "\n".join(f"SKU {k}123 35mm filter {k}9.99 EUR add to cart" for k in range(9)),
    "tags": " ★ ".join(["lens new", "flash led", "bag strap", "zoom macro", "prime travel", "sale filter", "apsc bokeh"] * 3),
    "hashes": " ".join(f"#{w}" for w in "lens battery new led sale lens filter bag zoom strap prime macro".split()),
}
CLEAN = {
    "prose": PROSE * 3 + (" " + PROSE) * 3,
    "repeated": (PROSE + " ") * 30,
    "readings": "\n".join(f"1/{k}5 f/8 ISO {k}00, 12:{k}0" for k in range(1, 9)),
    "urls": "\n".join(f"https://a{k}.test/x/{k} {PROSE} {PROSE}" for k in range(4)),
    "template": " ".join(f"The road to Town{k} was closed, so we turned back at the bridge." for k in range(30)),
    "half": PROSE * 4 + "\n" + " ".join(["#lens"] * 12),
}


@pytest.mark.parametrize("name", SPAM)
def test_spam_words(name):
    spam, total = stuffing.spam_words(SPAM[name])
    assert spam > 0.55 * total >= 5


@pytest.mark.parametrize("name", CLEAN)
def test_clean_words(name):
    spam, total = stuffing.spam_words(CLEAN[name])
    assert spam <= 0.5 * total


def test_stuffed_pages(spark):
    rng = random.Random(9)
    nouns = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) for _ in range(500)]
    verbs = "saw found left opened crossed painted moved held lost kept".split()

    def story():
        return " ".join(f"{rng.choice(['The', 'A', 'My'])} {rng.choice(nouns)} of the {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} and it was in the {rng.choice(nouns)}." for _ in range(rng.randrange(3, 30)))

    rows = [(k, story(), "en", "x") for k in range(200)] + [(1000 + k, t, None if k % 2 else "en", "x") for k, t in enumerate(SPAM.values())]
    rows += [(2000, None, "en", "x"), (2001, "", "en", "x"), (2002, "#a #b #c", "en", "x"), (2003, "word " * 200_000, "zz", "x"), (None, "x " * 30, "en", "x"), (1000, SPAM["phrase"], "en", "x")]
    got = stuffing.find_spam(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, words string"))
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(ids) == [*range(1000, 1000 + len(SPAM)), 2003]
    assert stuffing.find_spam(spark.createDataFrame([], "doc_id bigint, text string, lang string, words string")).count() == 0


def test_stuffed_pages_that_fill_their_language_and_length(spark):
    rows = [(k, SPAM["filler"], "en") for k in range(100)] + [(1000 + k, CLEAN["template"], "en") for k in range(20)]
    got = stuffing.find_spam(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(100))


def test_copies_of_a_stuffed_page_do_not_become_the_reference(spark):
    """A third of all rows are one page and its near copies, in a language that has a model."""
    rng = random.Random(10)
    nouns = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) for _ in range(900)]
    small_words = "the a of in and it was on that from with were to for so had them an old two by before still are we up our like at is".split()
    story = lambda: " ".join(rng.choices(small_words, [1 / (k + 2) for k in range(30)])[0] if rng.random() < 0.5 else rng.choice(nouns) for _ in range(rng.randrange(40, 200)))
    rows = [(k, story(), "en") for k in range(400)] + [(1000 + k, SPAM["soup"] + (f" page {k}" if k % 2 else ""), "en") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    models = stuffing.language_models(df)
    assert set(models) == {"en"} and len(models["en"]) <= stuffing.MODEL_WORDS and models["en"].get("price", 0.0) < 0.02 < models["en"]["the"]
    figures = stuffing.curves(df)
    chosen = {r["doc_id"] for r in stuffing.suspects(figures).collect()}
    assert {1000 + k for k in range(200)} <= chosen and len(chosen) < 240
    assert {r["doc_id"] for r in stuffing.find_spam(df).collect()} == {1000 + k for k in range(200)}


def test_every_page_counts_in_its_language(spark):
    """Pages with one head are averaged, none is left out, and how rows are dealt to tasks changes nothing."""
    rng = random.Random(11)
    rest = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) for _ in range(3000)]
    rows = [(k, " ".join(["the"] * 9 + [rng.choice("abc") * 3] * 5 + [f"{w}{k}" for w in rng.sample(rest, 60)] + ["rare"] * (k % 2)), "en") for k in range(120)]
    rows += [(1000 + k, " ".join([f"top{k}"] * 8 + ["the"] * 4 + [f"{w}x{k}" for w in rng.sample(rest, 40)]), "en") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    by = {}
    for _, text, _ in rows:
        words = text.split()
        top = frozenset(w for w in set(words) if words.count(w) >= 0.02 * len(words))
        by.setdefault(top, []).append(words.count("rare") / len(words))
    share = sum(sum(v) / len(v) for v in by.values()) / len(by)
    for parts in (1, 5):
        model = stuffing.language_models(df.repartition(parts))["en"]
        assert len(by) == 63 and abs(model["rare"] - share) < 1e-9


def test_curve_of_a_page(spark):
    text = "a a a a b b c d " * 3
    row = stuffing.curves(spark.createDataFrame([(1, text, "xx"), (1, text, "xx"), (2, "too short", "xx"), (None, text, "xx"), (3, None, "xx")], "doc_id bigint, text string, lang string")).collect()
    assert len(row) == 1 and row[0]["words"] == 24 and row[0]["bucket"] == 4 and row[0]["divergence"] == 1.0
    slope, at = np.polyfit(np.log([1, 2, 3, 4]), np.log([12, 6, 3, 3]), 1)
    rest = np.log([12, 6, 3, 3]) - slope * np.log([1, 2, 3, 4]) - at
    assert abs(row[0]["slope"] - slope) < 1e-9 and abs(row[0]["residual"] - np.sqrt((rest**2).mean())) < 1e-9
