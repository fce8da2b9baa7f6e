"""Pages of repeated keywords, links and product tags, by their rank-frequency curves.

Each page's words are counted where its text is read; only its counts are shuffled, never the text. SQL windows rank them,
and three figures describe the curve: the slope of log frequency on log rank, the residual of that fit, and the divergence
from prose of the language, which is one less the share of the page's words that the language's most widespread words would
also make up in prose. No word counts for more than ``EXCESS`` times its usual share, so a page does not come closer to prose
by repeating one of them.

A page of which more than half the words are no prose holds at most half of what prose holds of those words, and a little by
chance. Pages below ``PROSE_SHARE`` of the language's upper quartile, within the scatter of their length, are suspects, as are pages whose slope or residual is
extreme among the other pages of the language at comparable lengths. Spam cannot become its own reference: all pages count, but
those with the same head of the curve count together as one page, the mean of them, the quartile stands until three quarters of a language are spam, and a language of
few such pages proves nothing, so that its pages are all suspects. An exact count of keyword, link and list words then
decides on each suspect.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograph.llm.words import _INVISIBLE, _TAG, _WORD
from heliograph.runtime import cut, cut_small, small

#: Words below which a text is no case.
LEAST_WORDS = 10
#: Share of spam words above which a page is one.
SPAM_SHARE = 0.5
#: Share of the prose that prose holds, at which a page may be spam.
PROSE_SHARE = 1 - SPAM_SHARE
#: Standard errors of a share counted over a page's words that are added to it, as short pages scatter.
SCATTER = 2.0
#: Interquartile deviations from the median at which a slope or a residual is extreme.
OUTLIER = 4.0
#: Most widespread words of a language that make its model, and times their usual share that count at most.
MODEL_WORDS, EXCESS = 200, 3.0
#: Different pages below which a language has no model, and the label of texts without a language.
MODEL_PAGES, UNKNOWN = 50, "un"
#: The head of a curve: its most frequent words, as far as each makes up this share of the page. Rarer ones tell near copies apart.
HEAD_WORDS, HEAD_SHARE = 8, 0.02
#: Heads of several pages up to which their numbers are sent to the pages.
HEADS = 500_000
#: Different words that a task holds before it hands their counts on.
HELD_WORDS = 200_000


def _page_counts(text: str) -> Counter:
    return Counter(_WORD.findall(_TAG.sub(" ", _INVISIBLE.sub("", text)).lower()))


def _head(lang: str, counts: Counter, total: int) -> int:
    """A digest of the language and the most frequent words of a page."""
    top = sorted(((-n, w) for w, n in counts.items() if n >= HEAD_SHARE * total))[:HEAD_WORDS]
    return xxhash.xxh64_intdigest(" ".join([lang, *sorted(w for _, w in top)])) - (1 << 63)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, head, total, counted) of each page of enough words: its words and their numbers, packed."""
    for batch in batches:
        rows = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = _page_counts(text)
            total = sum(counts.values())
            if total >= LEAST_WORDS:
                packed = "\n".join([" ".join(map(str, counts.values())), *counts]).encode()
                rows.append((lang, _head(lang, counts, total), total, zlib.compress(packed, 1)))
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["lang", "head", "total", "counted"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, total, counted, alike) to (lang, word, pages, share): how many pages hold a word, and the sum of its shares; '' counts pages.

    A page counts as one of ``alike``, the number of pages with the same head.
    """
    held: dict[tuple[str, str], list[float]] = {}

    def flush() -> pa.RecordBatch:
        columns = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), *(pa.array([v[c] for v in held.values()], pa.float64()) for c in range(2))]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "pages", "share"])

    for batch in batches:
        for lang, total, counted, alike in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            numbers, *words = zlib.decompress(counted).decode().split("\n")
            for word, n in [("", total), *zip(words, map(int, numbers.split()), strict=True)]:
                own = held.setdefault((lang, word), [0.0, 0.0])
                own[0] += 1 / alike
                own[1] += n / total / alike
        if len(held) > HELD_WORDS:
            yield flush()
    yield flush()


def _with_language(documents: DataFrame) -> DataFrame:
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.select(F.col("doc_id").cast("bigint"), F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise(UNKNOWN).alias("lang"), "text")


def language_models(documents: DataFrame) -> dict[str, dict[str, float]]:
    """The usual share of each of the ``MODEL_WORDS`` most widespread words of every language of at least ``MODEL_PAGES`` pages.

    What reaches the driver is bounded by the languages and their words, whatever the number of documents.
    """
    pages = cut(_with_language(documents).where(F.col("lang") != UNKNOWN).select("lang", "text").mapInArrow(_heads, "lang string, head bigint, total bigint, counted binary"))
    alike = cut_small(pages.groupBy("head").agg(F.count("*").alias("alike")).where("alike > 1"), HEADS)
    weighed = pages.join(alike, "head", "left").select("lang", "total", "counted", F.coalesce("alike", F.lit(1)).alias("alike"))
    spread = weighed.mapInArrow(_spread, "lang string, word string, pages double, share double")
    # rounded, as sums of fractions depend on their order
    spread = spread.groupBy("lang", "word").agg(F.round(F.sum("pages"), 6).alias("pages"), F.sum("share").alias("share"))
    ranked = spread.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("pages"), "word"))).where(F.col("k") <= MODEL_WORDS + 1)
    found: dict[str, dict[str, tuple[float, float]]] = {}
    for lang, word, pages, share in ranked.select("lang", "word", "pages", "share").collect():
        found.setdefault(lang, {})[word] = pages, share
    models = {lang: (own[""][0], own) for lang, own in found.items() if "" in own and own[""][0] >= MODEL_PAGES}
    return {lang: {w: share / pages for w, (_, share) in own.items() if w} for lang, (pages, own) in models.items()}


def curves(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, words, slope, residual, divergence, bucket) of every different text of at least ten words.

    ``lang`` is the language whose prose the page comes closest to, since labels are missing or wrong; the divergence is 1
    where no language has a model. ``bucket`` is the binary logarithm of the words. One row for each doc_id and text.
    """
    models = language_models(documents)
    usual: dict[str, list[tuple[str, float]]] = {}  # bounded by the languages and their words
    for lang, model in models.items():
        for word, share in model.items():
            usual.setdefault(word, []).append((lang, EXCESS * share))
    held = documents.sparkSession.sparkContext.broadcast(usual)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = held.value
        for batch in batches:
            rows = []
            for doc_id, label, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                counts = _page_counts(text)
                total = sum(counts.values())
                if total >= LEAST_WORDS:
                    near: dict[str, float] = {}
                    for word in counts.keys() & usual.keys():
                        for lang, most in usual[word]:
                            near[lang] = near.get(lang, 0.0) + min(counts[word], max(most * total, 1.0))
                    share, lang = max(((n / total, lang) for lang, n in near.items()), default=(0.0, label))
                    rows.append((doc_id, xxhash.xxh64_intdigest(text) - (1 << 63), lang, total, 1 - share, sorted(counts.values(), reverse=True)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "page", "lang", "words", "divergence", "counts"])

    pages = _with_language(documents).mapInArrow(count, "doc_id bigint, page bigint, lang string, words bigint, divergence double, counts array<int>")
    # one shuffle of the counts; ranking and fitting stay within its partitions
    key = ["doc_id", "page"]
    pages = pages.repartition(*key).dropDuplicates(key)
    ranked = pages.select(*key, "lang", "words", "divergence", F.explode("counts").alias("f"))
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("f"))))
    x, y = F.log("r"), F.log("f")
    fit = ranked.groupBy(*key).agg(
        *(F.first(c).alias(c) for c in ("lang", "words", "divergence")), F.regr_slope(y, x).alias("slope"), F.regr_syy(y, x).alias("syy"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("distinct_words")
    )
    return fit.select(
        "doc_id", "lang", "words",
        F.coalesce("slope", F.lit(0.0)).alias("slope"),
        F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.col("syy") * (1 - F.coalesce("r2", F.lit(1.0)))) / F.col("distinct_words")), F.lit(0.0)).alias("residual"),
        "divergence",
        F.floor(F.log2("words")).cast("int").alias("bucket"),
    )


def suspects(figures: DataFrame, prose_share: float = PROSE_SHARE, outlier: float = OUTLIER) -> DataFrame:
    """The rows of ``figures`` that hold too little prose, or whose slope or residual is extreme among those that do not."""
    near = 1 - F.col("divergence")
    prose = small(cut(figures.groupBy("lang").agg(F.percentile_approx(near, 0.75, 10_000).alias("prose"))))
    held = figures.join(prose, "lang")
    little = near <= prose_share * F.col("prose") + SCATTER * 0.5 / F.sqrt("words")
    names = ["slope", "residual"]
    bands = held.where(~little).groupBy("lang", "bucket").agg(*(F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(f"_{n}") for n in names))
    out = little
    for n in names:
        q = F.col(f"_{n}")
        out = out | (F.abs(F.col(n) - q[1]) > outlier * F.greatest(q[2] - q[0], F.lit(1e-6)) / 1.349)
    # pages of a length at which no page holds enough prose are suspects by that
    return held.join(small(cut(bands)), ["lang", "bucket"], "left").where(F.coalesce(out, F.lit(True))).select(*figures.columns)


_OPEN, _SHUT = "", ""
#: Links with their labels; of an anchor the address is markup, of the others it is text.
_MARKED_LINKS = [
    (re.compile(r"<a\b[^<>]*>(.*?)</a\s*>", re.S | re.I), rf"{_OPEN}\1{_SHUT}"),
    (re.compile(r"\[url(?:=[^\]]*)?\].*?\[/url\]", re.S | re.I), rf"{_OPEN}\g<0>{_SHUT}"),
    (re.compile(r"\[[^\[\]\n]*\]\(\s*[^()\s]*\s*\)"), rf"{_OPEN}\g<0>{_SHUT}"),
]
_FILES = "jpe?g|png|tiff?|gif|heic|webp|raw|dng|cr2|nef|arw|mp4|mov|avi|pdf|txt|docx?|zip|xmp|html?|csv|json"
_BARE_LINK = re.compile(rf"(?:https?|ftp)://\S+|\bwww\.\S+|\b(?:[a-z0-9][a-z0-9-]*\.)+(?!(?:{_FILES})\b)[a-z]{{2,12}}\b(?:/\S*)?", re.I)
_MONEY = re.compile(r"(?:[€$£¥]\s?\d|\d[\d.,]*\s?(?:€|\$|£|¥|(?:eur|usd|gbp|chf|euro|dollar)s?\b))|\bsku\b|\b(?:art|item)\.?[- ]?(?:nr|no)\b", re.I)
#: A list keeps to one separator; its characters tell cheaply whether a line can hold a list.
_SEPARATORS = [
    (chars, re.compile(p))
    for chars, p in (
        (";", r"\s*;\s*"), ("|", r"\s*\|\s*"), ("★☆", r"\s*[★☆]\s*"), ("•·●", r"\s*[•·●]\s*"), ("◆■►»", r"\s*[◆■►»]\s*"), ("*", r"\s*\*\s*"), ("/", r"\s*/\s+|\s+/\s*"),
        ("–—-", r"\s+[–—-]\s+"), (",", r"\s*,\s*"),
    )
]
#: The end of a name that may be a bare domain; a search that starts at the dot is fast.
_DOMAIN_END = re.compile(rf"\.(?!(?:{_FILES})\b)[a-z]{{2,12}}\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…:])\s+|(?<=[^\W\d_][.!?…])(?=[A-ZÀ-Ý¿¡])|\n+")
_LABEL_WORDS, _TAG_WORDS, _TAG_RUN, _PRODUCT_WORDS = 8, 4, 6, 20


def _line_words(line: str) -> tuple[list[str], list[bool]]:
    """Words of a line and whether each belongs to a link, a label, a product or a tag."""
    found, flags, spans = [], [], []
    depth = 0
    parts = re.split(f"([{_OPEN}{_SHUT}])", line)
    linked = _OPEN in line
    for part in parts:
        if part == _OPEN:
            depth += 1
        elif part == _SHUT:
            depth = max(0, depth - 1)
        else:
            own = _WORD.findall(part)
            spans.append((len(found), len(found) + len(own), part))
            label = linked and not depth and len(own) <= _LABEL_WORDS and not re.search(r"[.!?]\s*$", part.strip())
            found += own
            flags += [bool(depth) or label] * len(own)
    if 0 < len(found) <= _PRODUCT_WORDS and _MONEY.search(line) and not linked:
        return found, [True] * len(found)
    for start, stop, part in spans:
        if stop - start < _TAG_RUN:
            continue
        for chars, separator in _SEPARATORS:
            if sum(map(part.count, chars)) < _TAG_RUN - 1:
                continue
            pieces = separator.split(part)
            if len(pieces) < _TAG_RUN:
                continue
            at, run = start, []
            for piece in [*pieces, None]:
                n = len(_WORD.findall(piece)) if piece is not None else _TAG_WORDS + 1
                if n > _TAG_WORDS:
                    if len(run) >= _TAG_RUN and sum(any(c.isalpha() for w in found[a:b] for c in w) for a, b in run) > len(run) / 2:
                        for a, b in run:
                            flags[a:b] = [True] * (b - a)
                    run = []
                elif n:
                    run.append((at, at + n))
                at += n
    for m in re.finditer(r"#(\w[\w.]*)", line) if "#" in line else ():
        first = len(_WORD.findall(line[: m.start()]))
        for k in range(first, min(len(found), first + len(_WORD.findall(m.group(1))))):
            flags[k] = True
    return found, flags


def spam_words(text: str | None) -> tuple[int, int]:
    """(words of keyword phrases, links with their labels, and product and tag lists; all words) of a text."""
    if not text:
        return 0, 0
    text = _INVISIBLE.sub("", text.replace(_OPEN, " ").replace(_SHUT, " "))
    if "[" in text or "<" in text:
        for link, marked in _MARKED_LINKS:
            text = link.sub(marked, text)
        text = _TAG.sub(" ", text)
    if _DOMAIN_END.search(text) or "://" in text:
        text = _BARE_LINK.sub(lambda m: f"{_OPEN}{m.group()}{_SHUT}", text)
    found: list[str] = []
    flags: list[bool] = []
    sentences: list[tuple[int, int]] = []
    for line in text.split("\n"):
        base = len(found)
        own, marked = _line_words(line)
        found += (w.lower() for w in own)
        flags += marked
        at = base
        for sentence in _SENTENCE.split(line):
            n = len(_WORD.findall(sentence))
            sentences.append((at, at + n))
            at += n
    # phrases that recur within a sentence; templates and repeated sentences of prose recur only across sentences
    phrases: set[tuple[str, str]] = set()
    for a, b in sentences:
        distinct = len(set(found[a:b]))
        if b - a - distinct < 2:  # a phrase that recurs repeats two words
            continue
        seen = Counter(zip(found[a:b], found[a + 1 : b], strict=False))
        phrases.update(p for p, n in seen.items() if n >= 2 and not (p[0].isdigit() and p[1].isdigit()))
        if b - a >= 30 and distinct < 0.3 * (b - a) and not sum(w.isdigit() for w in found[a:b]) > (b - a) / 2:
            flags[a:b] = [True] * (b - a)
    if phrases:
        often = Counter(p for p in zip(found, found[1:], strict=False) if p in phrases)
        for k, p in enumerate(zip(found, found[1:], strict=False)):
            if often.get(p, 0) >= 4:
                flags[k] = flags[k + 1] = True
    return sum(flags), len(found)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spam, total = spam_words(text)
            if total >= LEAST_WORDS and spam > SPAM_SHARE * total:
                kept.append((doc_id, spam, total))
        yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in kept], pa.int64()) for c in range(3)], names=["doc_id", "spam_words", "words"])


def find_spam(documents: DataFrame) -> DataFrame:
    """(doc_id, spam_words, words): the pages of which more than half the words are keywords, links or lists.

    The suspects by their curves are checked exactly, over their whole texts. Null, empty and short texts are no cases; a
    null or unreadable language counts as none; repeated rows are reported once each doc_id, and of different texts with
    one doc_id each is judged by itself. An empty table gives an empty result; further columns are ignored.
    """
    chosen = small(cut(suspects(cut(curves(documents))).select("doc_id").distinct()))
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text").join(chosen, "doc_id", "left_semi")
    checked = texts.mapInArrow(_verify, "doc_id bigint, spam_words bigint, words bigint")
    return checked.groupBy("doc_id").agg(F.max("spam_words").alias("spam_words"), F.max("words").alias("words"))
