"""Passages of held-out items in a corpus, by a generalised suffix automaton over words.

An automaton holds all items of a group; each document's words run through it, keeping at every word the length of the
longest item passage that ends there. Items that are too many for one automaton are cut into groups of bounded size. The
corpus is read once a group, never shuffled, and neither the driver nor a worker ever holds more than one group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.words import words, words_in_place
from heliograph.runtime import cut, small

#: Consecutive words that make a leak.
LEAST_WORDS = 13
#: Words of one automaton, about: some 150 MB. A longer item is a group by itself.
AUTOMATON_WORDS = 200_000
#: Share of a document's words that leaks may cover before it goes as a whole.
MOST_COVERED = 0.5


class SuffixAutomaton:
    """Suffix automaton of several word sequences; ``owners`` gives the sequences that hold a passage of ``least`` words."""

    def __init__(self, texts: list[tuple[int, list[str]]], least: int) -> None:
        self.least = least
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        marks: list[tuple[int, int]] = []
        for owner, text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)
                marks.append((last, owner))
        held: list[set[int]] = [set() for _ in self.link]
        for state, owner in marks:
            held[state].add(owner)
        # only states of at least `least` words need their owners, so no set grows towards the root
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= least:
                held[self.link[state]] |= held[state]
        # of every state of at least `least` words: the owners of its suffix of just `least` words
        self.owners: list[frozenset[int] | None] = [None] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[state] >= least:
                above = self.link[state]
                self.owners[state] = self.owners[above] if self.length[above] >= least else frozenset(held[state])

    def _extend(self, last: int, word: str) -> int:
        following, link, length = self.next, self.link, self.length
        if word in following[last]:
            q = following[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = len(link)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: str, q: int) -> int:
        following, link, length = self.next, self.link, self.length
        clone = len(link)
        following.append(dict(following[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and following[p].get(word) == q:
            following[p][word] = clone
            p = link[p]
        return clone

    def matches(self, text: list[str]) -> list[tuple[int, int, frozenset[int]]]:
        """(end, length, owners) at each word where a passage of at least ``least`` words ends."""
        following, link, length, owners, least = self.next, self.link, self.length, self.owners, self.least
        out = []
        state = held = 0
        root = following[0]
        for end, word in enumerate(text):
            if word not in root:
                state = held = 0
                continue
            while word not in following[state]:
                state = link[state]
                held = length[state]
            state = following[state][word]
            held += 1
            if held >= least:
                # a state's shorter passages belong to its suffix links
                at = state
                while length[link[at]] >= held:
                    at = link[at]
                out.append((end, held, owners[at]))
        return out


def _automaton(name: str, items: list[tuple[int, str]], least: int) -> SuffixAutomaton:
    """The automaton of the group ``name``, built once a worker process; the one before it is given up."""
    held = vars(pa).setdefault("_leak_automaton", {})  # functions are sent anew with each task, modules stay
    if (name, least) not in held:
        held.clear()
        held[name, least] = SuffixAutomaton([(i, words(t)) for i, t in items], least)
    return held[name, least]


def _spans(automaton: SuffixAutomaton, text: list[str]) -> dict[int, list]:
    """owner: [longest, first and last word of each passage, alternately]; overlapping passages are one."""
    best: dict[int, list] = {}
    for end, length, owners in automaton.matches(text):
        for owner in owners:
            own = best.setdefault(owner, [0, []])
            own[0] = max(own[0], length)
            # the owner holds at least the last `least` words
            first = end - automaton.least + 1
            if own[1] and first <= own[1][-1] + 1:
                own[1][-1] = end
            else:
                own[1] += [first, end]
    return best


_FOUND = "doc_id bigint, page bigint, item_id bigint, longest bigint, covered bigint, spans array<bigint>"


def leak_spans(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, page, item_id, longest, covered, spans): where documents hold at least ``least`` consecutive words of items.

    page: the hash of the document's text. longest: words of the longest shared passage. covered: the document's words that
    lie in such passages. spans: numbers of the first and the last word of each, alternately. Null and empty texts, texts and
    items shorter than ``least`` words, and null ids match nothing; repeated rows are reported as often as they occur.

    Items are a stated query set against all documents, in blocks of ``AUTOMATON_WORDS``.
    """
    spark = documents.sparkSession
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("page"), "text")
    usable = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint"), "text").distinct()
    total = usable.agg(F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()[0]
    groups = -(-total // AUTOMATON_WORDS)
    found = []
    for group in range(groups):
        own = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group)
        sent = spark.sparkContext.broadcast(sorted((r[0], r[1]) for r in own.toLocalIterator()))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, sent.value, least)
            for batch in batches:
                rows = []
                for doc_id, page, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    for item_id, (longest, spans) in _spans(automaton, words(text)).items():
                        rows.append((doc_id, page, item_id, longest, sum(spans[1::2]) - sum(spans[::2]) + len(spans) // 2, spans))
                types = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                names = ["doc_id", "page", "item_id", "longest", "covered", "spans"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        held = texts.mapInArrow(scan, _FOUND)
        found.append(held if groups == 1 else cut(held))
        if groups > 1:
            sent.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _FOUND)


def find_leaks(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, longest, covered): the documents that hold at least ``least`` consecutive words of an item's text.

    As ``leak_spans``, once for each document and item; of different texts with one doc_id the most covered one counts.
    """
    spans = leak_spans(documents, items, least)
    return spans.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("covered").alias("covered"))


def strip_leaks(documents: DataFrame, spans: DataFrame, least: int = LEAST_WORDS, most_covered: float = MOST_COVERED) -> DataFrame:
    """``documents`` without the passages of ``leak_spans`` of at least ``least`` words, and without those mostly covered.

    Passages of all items count together, overlapping ones once. A passage goes with what lies between its words; a document
    of whose words more than ``most_covered`` lie in passages goes as a whole. Other documents stay as they are, as do rows
    with null ids or texts, and all other columns.
    """
    each = spans.select("doc_id", "page", F.explode(F.transform(F.sequence(F.lit(0), F.size("spans") - 1, F.lit(2)), lambda k: F.struct(F.get("spans", k).alias("first"), F.get("spans", k + 1).alias("last")))).alias("s"))
    marks = each.where(F.col("s.last") - F.col("s.first") + 1 >= least).groupBy(F.col("doc_id").alias("_d"), F.col("page").alias("_p")).agg(F.sort_array(F.collect_set("s")).alias("_marks"))
    columns = documents.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, keep = batch.column(at).to_pylist(), []
            for k, marks_ in enumerate(batch.column(len(columns)).to_pylist()):
                placed, merged = words_in_place(texts[k]), []
                for m in marks_:
                    if merged and m["first"] <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], m["last"])
                    else:
                        merged.append([m["first"], m["last"]])
                if sum(b - a + 1 for a, b in merged) > most_covered * len(placed):
                    continue
                for a, b in reversed(merged):
                    texts[k] = texts[k][: placed[a][1]] + texts[k][placed[b][2] :]
                keep.append(k)
            arrays = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns).take(pa.array(keep, pa.int64()))

    joined = documents.join(small(cut(marks)), (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_p")), "left")
    whole = joined.where("_marks IS NULL").select(*columns)
    cleaned = joined.where("_marks IS NOT NULL").select(*columns, "_marks").mapInArrow(clean, documents.schema)
    return whole.unionByName(cleaned)
