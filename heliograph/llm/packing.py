"""Texts packed into containers of a fixed number of tokens, by patterns fitted with non-negative least squares.

Only the histogram of lengths reaches the driver; it has as many entries as the capacity. Patterns of few documents that
nearly fill a container are enumerated from the lengths that occur, their repeat counts are fitted to the histogram, rounded
down, and what remains is packed best fit first, also by counts. The plan says how many documents of each length go where;
every document then finds its place from its rank among those of its length. Ranks are counted in salted parts, so a length
that a third of all documents share is never sorted in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograph.runtime import cut

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's tokenizer splits a text before its merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens that a pattern may leave free.
SLACK = 8
#: Lengths that are put beside each length in patterns; the plan's size depends on this and on the capacity, never on the documents.
COMPANIONS = 24
#: Share of the squares that rounds of the fit must take off to go on.
SETTLED = 0.003
#: Documents of one length that are ranked together, about.
RANK_PART = 200_000


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """(doc_id, tokens) of whole texts; null and empty texts have 0 tokens. Repeated doc_ids keep their longest text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        held = vars(tiktoken).setdefault("_by_path", {})  # lives as long as the worker process
        if (tokenizer, pattern) not in held:
            with open(tokenizer, "rb") as lines:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
            held[tokenizer, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encoding = held[tokenizer, pattern]
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    texts = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(count, "doc_id bigint, tokens bigint").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def enumerate_patterns(histogram: np.ndarray, capacity: int, slack: int = SLACK) -> list[tuple[tuple[int, int], ...]]:
    """Patterns ((length, copies), ...) of up to four different lengths that fill a container up to ``slack`` tokens.

    ``histogram[l]`` counts the items of length l. Each length that occurs starts patterns: one, two or as many copies as fit,
    with one or as many copies of each of ``COMPANIONS`` other lengths, closed by the length that fits best, or by two of them.
    """
    lengths = np.flatnonzero(histogram[1:]) + 1
    if not len(lengths):
        return []
    # fits[s]: the largest length that occurs and fits into s; close[s]: the most frequent one that leaves at most `slack`
    fits = np.zeros(capacity + 1, np.int64)
    fits[lengths] = lengths
    fits = np.maximum.accumulate(fits).tolist()
    close = [0] * (capacity + 1)
    for space in range(1, capacity + 1):
        low = max(1, space - slack)
        window = histogram[low : space + 1]
        close[space] = low + int(window.argmax()) if window.max() > 0 else 0
    have = histogram.tolist()
    found: dict[tuple[tuple[int, int], ...], None] = {}

    def add(*items: tuple[int, int]) -> None:
        copies: dict[int, int] = {}
        for length, n in items:
            copies[length] = copies.get(length, 0) + n
        used = sum(length * n for length, n in copies.items())
        if capacity - slack <= used <= capacity and all(have[length] >= n for length, n in copies.items()):
            found[tuple(sorted(copies.items(), reverse=True))] = None

    # companions: lengths at even steps of the documents' distribution, so all sizes are met however they are spread
    steps = np.searchsorted(np.cumsum(histogram[lengths]), np.linspace(1, histogram[lengths].sum(), COMPANIONS))
    companions = np.unique(lengths[np.minimum(steps, len(lengths) - 1)]).tolist()
    for a in lengths.tolist():
        for n in {1, 2, capacity // a}:
            rest = capacity - a * n
            if rest < 0:
                continue
            add((a, n))
            if close[rest]:
                add((a, n), (close[rest], 1))
            for b in companions:
                for m in {1, rest // b} if rest >= b else ():
                    left = rest - b * m
                    if close[left]:
                        add((a, n), (b, m), (close[left], 1))
                    elif left > 0 and (c := fits[left]) and close[left - c]:
                        add((a, n), (b, m), (c, 1), (close[left - c], 1))
    return list(found)


def fit_counts(histogram: np.ndarray, patterns: list[tuple[tuple[int, int], ...]]) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths closest to the histogram in least squares.

    Multiplicative updates: they keep x non-negative, need no factorisation and touch only a pattern's own lengths. They go
    on until ten rounds lessen the squares by no more than the share ``SETTLED``.
    """
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([length for p in patterns for length, _ in p])
    value = np.array([n for p in patterns for _, n in p], float)
    h = histogram.astype(float)
    toward = np.bincount(column, value * h[row], len(patterns))
    x = np.full(len(patterns), h.sum() / max(1.0, value.sum()))
    before, rounds = np.inf, 0
    while True:
        made = np.bincount(row, value * x[column], len(h))
        if rounds % 10 == 0:
            now = float(((made - h) ** 2).sum())
            if not now < (1 - SETTLED) * before:
                return x
            before = now
        x *= toward / np.maximum(np.bincount(column, value * made[row], len(patterns)), 1e-12)
        rounds += 1


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """((pattern, repeats), ...) that places every item of the histogram exactly once and never exceeds the capacity."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(pattern: tuple[tuple[int, int], ...], most: int) -> None:
        repeats = min([most, *(int(left[length]) // n for length, n in pattern)])
        if repeats > 0:
            for length, n in pattern:
                left[length] -= n * repeats
            out.append((pattern, repeats))

    patterns = enumerate_patterns(left, capacity)
    if patterns:
        counts = np.floor(fit_counts(left, patterns) + 1e-9).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= 0:
                break
            take(patterns[k], int(counts[k]))
    # the residual: the largest item, then always the largest that still fits; the same container as often as it can be had
    while left.any():
        present = np.flatnonzero(left)
        copies: dict[int, int] = {}
        space, at = capacity, len(present) - 1
        while at >= 0 and space >= present[0]:
            at = min(at, int(np.searchsorted(present, space, "right")) - 1)
            if at < 0:
                break
            length = int(present[at])
            n = min(int(left[length]), space // length)
            copies[length] = n
            space -= n * length
            at -= 1
        take(tuple(copies.items()), int(left.sum()))
    return out


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens, container_id) for (doc_id, tokens): every piece of every document in just one container.

    A document is split only if it alone exceeds the capacity: into full containers and one remainder, numbered from 0.
    Documents without tokens take no room and go to container 0. Ids are unique; an empty table gives an empty result.
    """
    spark = lengths.sparkSession
    t = F.col("tokens")
    pieces = cut(
        lengths.select("doc_id", t, F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.expr(f"(tokens - 1) div {capacity}")))).alias("piece"))
        .select("doc_id", "piece", F.least(F.lit(capacity), t - F.col("piece") * capacity).cast("bigint").alias("tokens"))
    )
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("tokens").agg(F.count("*").alias("n")).collect():  # at most one row a length
        histogram[length] = n
    starts, bases, copies = [], [], []
    begun, container = np.zeros(capacity + 1, np.int64), 0
    for pattern, repeats in plan(histogram, capacity):
        for length, n in pattern:
            starts.append((length << 40) + int(begun[length]))
            bases.append(container)
            copies.append(n)
            begun[length] += n * repeats
        container += repeats
    order = np.argsort(np.array(starts, np.int64))
    held = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (starts, bases, copies)))
    parts = max(1, -(-int(histogram.max()) // RANK_PART))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = salted.groupBy("tokens", "salt").agg(F.count("*").alias("n"))
    before = before.select("tokens", "salt", (F.sum("n").over(W.partitionBy("tokens").orderBy("salt")) - F.col("n")).alias("offset"))
    within = F.row_number().over(W.partitionBy("tokens", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("w", within).join(before, ["tokens", "salt"]).select("doc_id", "piece", "tokens", (F.col("w") + F.col("offset")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, copy = held.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            key = (length << 40) + rank
            at = np.maximum(np.searchsorted(keys, key, "right") - 1, 0)
            where = np.zeros(len(key), np.int64) if not len(keys) else np.where(length == 0, 0, base[at] + (key - keys[at]) // copy[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(where)], names=["doc_id", "piece", "tokens", "container_id"])

    return ranked.mapInArrow(place, "doc_id bigint, piece bigint, tokens bigint, container_id bigint")
