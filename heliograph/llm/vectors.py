"""Most similar vectors by a block matrix join.

Vectors are normalised, placed at their nearest pivot and dealt into groups of bounded size, pivot by pivot. The groups are
written once, as files beside the checkpoints; a task reads those of one pair of groups after the other, so the disk holds
each vector as often whatever the number of groups. Pairs of groups of which no cells are within reach of each other, by the
cells' radii and the least similarity, are no tasks. A task sorts a group by pivot, cuts it into blocks, and goes through the
tiles, the pairs of blocks. A tile is skipped when the blocks' centres and radii prove that no pair in it reaches the least similarity. Otherwise
the vectors' int8 codes, which have one scale a block, are multiplied. The products are whole numbers below 2^24, so float32
holds them exactly and a fast matrix product may be used; with the quantisation error's bound they give a bound on each
similarity. Only pairs that the bound cannot rule out, against the least similarity and against the best found so far, are
computed again from the floats. Each vector keeps a heap of its k best in the task, and the heaps of the tasks are merged.
The result is exact.

The number of tiles grows with the square of the number of distinct vectors, as any exact join without a usable index does;
the codes, blocks and bounds only make each tile cheap.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograph.runtime import cut, ensure_checkpoint_dir, release, small

DIMENSIONS = 128
#: Vectors of one side of a tile.
BLOCK = 1024
#: Vectors of one side of a task at most, about: 34 MB of floats. Each vector is read by as many tasks as there are groups.
GROUP = 65_536
#: Groups that a task compares with one at most, and tasks from which on it compares more than one.
STRIP, TASKS = 8, 256
#: Rows of ids and digests up to which they are sent to the vectors, so that these need not move.
SENT = 500_000
#: Vectors that order the blocks, at most; they are a sample, but every vector is placed by them.
PIVOTS = 256
#: Distance from their pivot up to which vectors form blocks of their own, by pivot, so that tiles can be skipped.
TIGHT = 0.75
#: Share of a tile's pairs above which it is computed again as a whole rather than pair by pair.
DENSE = 0.02
#: Candidates that a task's heaps take in before they are pruned.
HEAP_ROWS = 1_000_000


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """True for vectors of just ``dimensions`` finite numbers that are not all zero; never null."""
    good = (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def floats(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """Rows of a binary column of float32 values without nulls, read in place where it is one piece."""
    parts = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c):
            c = c.cast(pa.binary())
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(-1, dimensions))
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty((0, dimensions), np.float32), *parts])


def units(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, u): the usable vectors of (id, vector) scaled to length 1, as float32 bytes; a map without a shuffle."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)
                raw /= np.abs(raw).max(axis=1, keepdims=True)
                raw /= np.linalg.norm(raw, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in raw.astype(np.float32)], pa.binary())], names=["id", "u"])

    good = vectors.where(F.col("id").isNotNull() & usable(F.col("vector"), dimensions)).select(F.col("id").cast("bigint"), F.col("vector").cast("array<double>"))
    return good.mapInArrow(scale, "id bigint, u binary")


def pivots_of(rows: DataFrame, seed: int = 0, pivots: int = PIVOTS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vectors of the ``pivots`` rows of smallest hash."""
    picked = rows.select("u", F.xxhash64("id", F.lit(seed)).alias("h"), "id").orderBy("h", "id").limit(pivots).select("u").toArrow()
    return np.array(floats(picked.column("u"), dimensions))


def nearest_pivot(rows: DataFrame, centres: np.ndarray, dimensions: int = DIMENSIONS) -> DataFrame:
    """``rows`` (with u) plus the number of the nearest of the ``centres``, the distance from it and the vector's length."""
    columns = rows.columns
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", pivot int, far double, norm double"
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        squares = np.einsum("ij,ij->i", own, own)
        for batch in batches:
            if batch.num_rows:
                u = floats(batch.column(columns.index("u")), dimensions)
                near = np.argmin(squares - 2 * (u @ own.T), axis=1)
                far = np.linalg.norm(u.astype(np.float64) - own[near], axis=1)
                added = [pa.array(near, pa.int32()), pa.array(far), pa.array(np.linalg.norm(u.astype(np.float64), axis=1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, "pivot", "far", "norm"])

    return rows.mapInArrow(place, schema)


def _targets(cells: list[tuple[int, int, float, float]], centres: np.ndarray, groups: int, least: float) -> list[tuple[int, int, int, int, int]]:
    """(pivot, part, parts, group, other group): where the rows of each part of a pivot's cell go.

    ``cells``: pivot, rows, radius, longest vector. Cells that are close come together in a group; large cells are dealt into
    parts. A part goes to its own group and to each other one that holds a cell within its reach.
    """
    left, order = {c[0]: c for c in cells}, [cells[0][0]]
    while len(order) < len(left):
        rest = [p for p in left if p not in set(order)]
        order.append(rest[int(np.argmin(np.linalg.norm(centres[rest] - centres[order[-1]], axis=1)))])
    size = max(1.0, sum(c[1] for c in cells) / groups)
    slots, placed, before = [], [], 0.0
    for p in order:
        parts = max(1, math.ceil(left[p][1] / size))
        for part in range(parts):
            share = left[p][1] / parts
            g = min(groups - 1, int((before + share / 2) / size))
            before += share
            slots.append((p, part, parts, g))
    for g in range(groups):
        placed.append(sorted({p for p, _, _, own in slots if own == g}))
    out = []
    for p, part, parts, g in slots:
        for h in range(groups):
            if placed[h]:
                radius, norm = np.array([left[q][2] for q in placed[h]]), np.array([left[q][3] for q in placed[h]])
                gap = np.maximum(0.0, np.linalg.norm(centres[placed[h]].astype(np.float64) - centres[p], axis=1) - radius - left[p][2])
                # x.y <= (|x|^2 + |y|^2 - d^2) / 2 with d at least the distance of the cells
                if ((norm**2 + left[p][3] ** 2 - gap**2) / 2 >= least - 1e-6).any():
                    out.append((p, part, parts, g, h))
    return out


class _Heaps:
    """The k best partners of each of n vectors: (value descending, id ascending), and the value a newcomer must reach."""

    def __init__(self, n: int, k: int, least: float) -> None:
        self.k, self.floor = k, np.full(n, least)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def push(self, at: np.ndarray, value: np.ndarray, partner: np.ndarray) -> None:
        keep = value >= self.floor[at]
        self.parts.append((at[keep], value[keep], partner[keep]))
        self.size += int(keep.sum())
        if self.size > HEAP_ROWS:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        at, value, partner = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((partner, -value, at))
        at, value, partner = at[order], value[order], partner[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) if len(at) else np.empty(0, np.int64)
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[at[full]] = np.maximum(self.floor[at[full]], value[full])
        at, value, partner = at[keep], value[keep], partner[keep]
        self.parts, self.size = [(at, value, partner)], len(at)
        return at, value, partner


class _Side:
    """One side of a task: vectors in blocks, with int8 codes of one scale a block, error bounds, centres and radii."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, pivot: np.ndarray) -> None:
        order = np.lexsort((ids, pivot))
        # a block for each tight cell of enough vectors, so that its tiles may be skipped, and blocks of all others
        cells, sizes = np.unique(pivot[order], return_counts=True)
        own = np.isin(pivot[order], cells[(cells < PIVOTS) & (sizes >= BLOCK // 4)])
        order = np.r_[order[own], order[~own]]
        self.ids, self.u = ids[order], u[order]
        cuts = np.flatnonzero(np.diff(pivot[order][: own.sum()])) + 1
        starts = sorted({*(cuts.tolist() if own.any() else []), *([0] if len(ids) else []), *([int(own.sum())] if not own.all() else [])})
        runs = zip(starts, [*starts[1:], len(ids)], strict=True)
        self.blocks = [slice(s, min(stop, s + BLOCK)) for start, stop in runs for s in range(start, stop, BLOCK)]
        self.scales = [max(float(np.abs(self.u[b]).max()), 1e-30) / 127 for b in self.blocks]
        self.codes = np.empty(self.u.shape, np.int8)
        self.errors, self.norms, self.centres, self.radii = [], [], [], []
        for b, scale in zip(self.blocks, self.scales, strict=True):
            self.codes[b] = np.rint(self.u[b] / scale)
            self.errors.append(float(np.linalg.norm(self.u[b] - self.codes[b] * np.float32(scale), axis=1).max()))
            self.norms.append(float(np.linalg.norm(self.u[b], axis=1).max()))
            self.centres.append(self.u[b].mean(axis=0))
            self.radii.append(float(np.linalg.norm(self.u[b] - self.centres[-1], axis=1).max()))
        self.centres = np.array(self.centres, np.float64).reshape(len(self.blocks), -1)


def _tiles(a: _Side, b: _Side, same: bool, least: float, k: int, digits: int, left: _Heaps | None = None) -> tuple[_Heaps, _Heaps]:
    """The heaps of both sides; ``left`` are those that the first side has from other groups."""
    left = left or _Heaps(len(a.ids), k, least)
    right = left if same else _Heaps(len(b.ids), k, least)
    norms, radii = np.array(b.norms), np.array(b.radii)
    for i, rows in enumerate(a.blocks):
        codes = a.codes[rows].astype(np.float32)
        gaps = np.maximum(0.0, np.linalg.norm(b.centres - a.centres[i], axis=1) - a.radii[i] - radii)
        within = (a.norms[i] ** 2 + norms**2 - gaps**2) / 2 >= least - 1e-6
        for j in np.flatnonzero(within).tolist():
            if same and j < i:
                continue
            columns = b.blocks[j]
            product = codes @ b.codes[columns].astype(np.float32).T  # whole numbers, exact
            slack = a.errors[i] * b.norms[j] + b.errors[j] * (a.norms[i] + a.errors[i]) + 2e-6
            scale = a.scales[i] * b.scales[j]
            bound = math.floor((least - slack) / scale)
            if product.max() < bound:
                continue
            x, y = np.divmod(np.flatnonzero(product.ravel() >= bound), product.shape[1])
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if not len(x):
                continue
            sure = product[x, y] * scale + slack
            x, y = x + rows.start, y + columns.start
            open_ = (sure >= left.floor[x]) | (sure >= right.floor[y])
            x, y = x[open_], y[open_]
            if len(x) > DENSE * product.size:
                whole = np.round(a.u[rows].astype(np.float64) @ b.u[columns].astype(np.float64).T, digits)
                if same and i == j:
                    np.fill_diagonal(whole, -np.inf)
                # only the k best of the tile for each vector, and what ties with them, may enter its heap
                ways = [(left, b.ids, whole, rows.start, columns.start), (right, a.ids, whole.T, columns.start, rows.start)]
                for heap, ids, table, first, other in ways[: 1 if same and i == j else 2]:
                    best = np.partition(table, -min(k, table.shape[1]), axis=1)[:, -min(k, table.shape[1])]
                    x, y = np.nonzero(table >= np.maximum(best, least)[:, None])
                    heap.push(x + first, table[x, y], ids[y + other])
                continue
            else:
                value = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", a.u[x[s : s + 65536]], b.u[y[s : s + 65536]], dtype=np.float64) for s in range(0, len(x), 65536))])
            value = np.round(value, digits)
            good = value >= least
            x, y, value = x[good], y[good], value[good]
            left.push(x, value, b.ids[y])
            right.push(y, value, a.ids[x])
    return left, right


def _forest(a: _Side, b: _Side, same: bool, least: float, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, id, value) of pairs of at least ``least`` that join all vectors which such pairs join; one less than they are at most."""
    shift = 0 if same else len(a.ids)
    label = np.arange(shift + len(b.ids))
    norms, radii = np.array(b.norms), np.array(b.radii)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for i, rows in enumerate(a.blocks):
        codes = a.codes[rows].astype(np.float32)
        gaps = np.maximum(0.0, np.linalg.norm(b.centres - a.centres[i], axis=1) - a.radii[i] - radii)
        within = (a.norms[i] ** 2 + norms**2 - gaps**2) / 2 >= least - 1e-6
        for j in np.flatnonzero(within).tolist():
            columns = b.blocks[j]
            if same and j < i or (np.r_[label[rows], label[columns.start + shift : columns.stop + shift]] == label[rows.start]).all():
                continue
            product = codes @ b.codes[columns].astype(np.float32).T  # whole numbers, exact
            slack = a.errors[i] * b.norms[j] + b.errors[j] * (a.norms[i] + a.errors[i]) + 2e-6
            bound = math.floor((least - slack) / (a.scales[i] * b.scales[j]))
            if product.max() < bound:
                continue
            x, y = np.divmod(np.flatnonzero(product.ravel() >= bound), product.shape[1])
            x, y = x + rows.start, y + columns.start
            if same:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), 65_536):
                p, q = x[at : at + 65_536], y[at : at + 65_536]
                open_ = label[p] != label[q + shift]
                p, q = p[open_], q[open_]
                value = np.round(np.einsum("ij,ij->i", a.u[p], b.u[q], dtype=np.float64), digits)
                good = value >= least
                p, q, value = p[good], q[good], value[good]
                while len(p):
                    # of each label's pairs the one with the smallest other label joins it to that
                    low, high = np.minimum(label[p], label[q + shift]), np.maximum(label[p], label[q + shift])
                    order = np.lexsort((low, high))
                    first = order[np.r_[True, np.diff(high[order]) > 0]]
                    out.append((a.ids[p[first]], b.ids[q[first]], value[first]))
                    root = np.arange(len(label))
                    root[high[first]] = low[first]
                    while (root[root] != root).any():
                        root = root[root]
                    label = root[label]
                    open_ = label[p] != label[q + shift]
                    p, q, value = p[open_], q[open_], value[open_]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _groups(n: int, group: int) -> int:
    """Groups of at most about ``group`` of n vectors; smaller inputs are cut a little finer, so that cores are not idle."""
    return max(-(-n // group), min(2, -(-n // (4 * BLOCK))), 1)


def similar_pairs(rows: DataFrame, least: float, k: int, dimensions: int = DIMENSIONS, group: int = GROUP, digits: int = 6, *, forest: bool = False) -> DataFrame:
    """(kind, id, partner, value): for each vector its ``k`` largest products of at least ``least`` with others of its kind.

    ``rows``: kind, id, u (float32 bytes, of any length), ids unique within a kind. Values are rounded to ``digits`` decimals
    and ties go to the smaller partner. An empty table gives an empty result. With ``forest`` the pairs are not the largest, but
    so many as join all vectors which pairs of at least ``least`` join; ``k`` does not count then.
    """
    spark = rows.sparkSession
    counts = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # as many as kinds
    folder = f"{ensure_checkpoint_dir(spark)}/groups-{uuid.uuid4().hex}"
    strips: list[tuple[int, str, int, list[int]]] = []
    try:
        for number, (kind, n) in enumerate(counts.items()):
            own = rows.where(F.col("kind") == kind).drop("kind")
            centres = pivots_of(own, pivots=PIVOTS, dimensions=dimensions)
            own = nearest_pivot(own, centres, dimensions)
            cells = own.groupBy("pivot").agg(F.count("*"), F.max("far"), F.max("norm")).orderBy("pivot").collect()  # at most one a pivot
            groups = _groups(n, group)
            targets = _targets([tuple(c) for c in cells], centres, groups, least)
            slots = small(spark.createDataFrame(sorted({t[:4] for t in targets}), "pivot int, part int, parts int, g int"), SENT)
            dealt = own.join(slots, "pivot").where(F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")) == F.col("part"))
            cell = F.when(F.col("far") <= TIGHT, F.col("pivot")).otherwise(F.col("pivot") + PIVOTS).alias("pivot")
            dealt.select("id", "u", cell, "g").repartition(max(2 * groups, 8), "g").write.partitionBy("g").parquet(f"{folder}/{number}")
            release(spark)  # the shuffle that the files were written from
            reach: dict[int, set[int]] = {}
            for *_, g, h in targets:
                reach.setdefault(min(g, h), set()).add(max(g, h))
            length = max(1, min(STRIP, sum(map(len, reach.values())) // TASKS))
            strips += [(number, kind, lo, sorted(his)[at : at + length]) for lo, his in reach.items() for at in range(0, len(his), length)]
        if not strips:
            return spark.createDataFrame([], "kind string, id bigint, partner bigint, value double")
        todo = spark.createDataFrame(strips, "number int, kind string, lo int, his array<int>").coalesce(1).repartition(len(strips))
        found = todo.mapInArrow(_compare(folder, least, k, dimensions, digits, forest), "kind string, id bigint, partner bigint, value double")
        if forest:
            return cut(found)
        best = W.partitionBy("kind", "id").orderBy(F.desc("value"), "partner")
        return cut(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"))
    finally:
        written = spark._jvm.org.apache.hadoop.fs.Path(folder)
        written.getFileSystem(spark._jsc.hadoopConfiguration()).delete(written, True)


def _compare(folder: str, least: float, k: int, dimensions: int, digits: int, forest: bool):
    """The function of (number, kind, lo, his): the k best of group ``lo`` in the groups ``his``, and of these in ``lo``, or a forest."""

    def side(number: int, g: int) -> _Side | None:
        held, path = fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", f"{folder}/{number}/g={g}"))
        if held.get_file_info(path).type == fs.FileType.NotFound:
            return None
        table = ds.dataset(path, filesystem=held, format="parquet").to_table(["id", "u", "pivot"], use_threads=False)
        ids, pivot, u = table.column("id").to_numpy(), table.column("pivot").to_numpy(), floats(table.column("u"), dimensions)
        at = np.unique(ids, return_index=True)[1]  # a repeated row of one id is the same vector
        return _Side(ids[at], u[at], pivot[at])

    def told(kind: str, ids: np.ndarray, partners: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.string()), pa.array(ids), pa.array(partners), pa.array(value)], names=["kind", "id", "partner", "value"])

    def best(kind: str, own: _Side, heaps: _Heaps) -> pa.RecordBatch:
        at, value, partner = heaps.prune()
        return told(kind, own.ids[at], partner, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, left = side(row["number"], row["lo"]), None
                for hi in row["his"] if a else ():
                    b = a if hi == row["lo"] else side(row["number"], hi)
                    if b and forest:
                        yield told(row["kind"], *_forest(a, b, a is b, least, digits))
                    elif b:
                        left, right = _tiles(a, b, a is b, least, k, digits, left)
                        if a is not b:
                            yield best(row["kind"], b, right)
                if left:
                    yield best(row["kind"], a, left)

    return run


def neighbours(vectors: DataFrame, least: float, k: int, dimensions: int = DIMENSIONS) -> DataFrame:
    """Distinct (kind, id_a, id_b), a < b, where one is among the ``k`` most similar of the other with a cosine of ``least``.

    ``vectors``: kind, id, vector. Only vectors of ``dimensions`` finite numbers that are not all zero take part; cosines are
    rounded to six decimals and ties go to the smaller id; a repeated id counts once; empty tables give an empty result.

    Exact copies of a vector are compared once, through the smallest id; each of them then takes its partners from the k + 1
    smallest ids of its own copies and of the copies of the vectors found, so copies are never expanded into all pairs.
    """
    kinds = [r[0] for r in vectors.select("kind").distinct().collect()]
    held = None
    for kind in kinds:
        own = units(vectors.where(F.col("kind") == kind).select("id", "vector"), dimensions).withColumn("kind", F.lit(kind))
        held = own if held is None else held.unionByName(own)
    if held is None:
        return vectors.sparkSession.createDataFrame([], "kind string, id_a bigint, id_b bigint")
    held = cut(held)
    # copies are found by a 128-bit digest, so that the vectors themselves are shuffled only once, to the tiles
    marks = cut(held.select("kind", "id", F.unhex(F.md5("u")).alias("h")).distinct())
    members = marks.groupBy("kind", "id").agg(F.min("h").alias("h"))
    classes = cut(members.groupBy("kind", "h").agg(F.min("id").alias("lead"), F.count("*").alias("copies")))
    chosen = classes.select("kind", F.col("lead").alias("id"), "h")
    others = cut(marks.join(chosen, ["kind", "id", "h"], "left_anti"))
    # the shorter of the two lists is sent; where both are long the vectors move, once
    few, how = min((others.count(), others, "left_anti"), (chosen.count(), chosen, "left_semi"), key=lambda x: x[0])[1:]
    moves = few.count() > SENT
    distinct = held.withColumn("h", F.unhex(F.md5("u"))).join(few.hint("shuffle_hash") if moves else small(few, SENT), ["kind", "id", "h"], how).select("kind", "id", "u")
    if moves:
        distinct = cut(distinct)
        del held, own
        release(vectors.sparkSession)
    found = similar_pairs(distinct, least, k, dimensions)
    copied = classes.where("copies > 1").select("kind", "h", "lead")
    members = members.join(copied, ["kind", "h"]).select("kind", "lead", "id")
    # the k + 1 smallest ids of a class, chosen in two steps so that no task holds a large class
    salted = W.partitionBy("kind", "lead", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = members.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).drop("r")
    few = few.withColumn("r", F.row_number().over(W.partitionBy("kind", "lead").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    few = cut(few)
    # partners of a class: vectors found, then its own copies, each with the smallest ids it stands for
    near = found.select("kind", F.col("id").alias("lead"), F.col("partner").alias("other"), "value")
    near = near.unionByName(copied.select("kind", "lead", F.col("lead").alias("other"), F.lit(1.0).alias("value")))
    spread = near.join(few.select("kind", F.col("lead").alias("other"), F.col("id").alias("copy")), ["kind", "other"], "left").select("kind", "lead", F.coalesce("copy", "other").alias("partner"), "value")
    top = spread.withColumn("r", F.row_number().over(W.partitionBy("kind", "lead").orderBy(F.desc("value"), "partner"))).where(F.col("r") <= k + 1)
    every = members.unionByName(classes.where("copies = 1").select("kind", "lead", F.col("lead").alias("id")))
    # at most k + 1 rows a member; the member itself drops out, then the k best remain
    own = every.join(top, ["kind", "lead"]).where("id != partner")
    ranked = own.withColumn("p", F.row_number().over(W.partitionBy("kind", "id").orderBy("r"))).where(F.col("p") <= k)
    return ranked.select("kind", F.least("id", "partner").alias("id_a"), F.greatest("id", "partner").alias("id_b")).distinct()
