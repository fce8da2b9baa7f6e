"""Exact and perceptual duplicate groups, keep-best marks, greedy leader grouping and non-maximum suppression."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograph.functions import exprs as X
from heliograph.functions import hashes as H
from heliograph.runtime import cut

#: Rows of one side of a task of the block product, about; each row goes to as many tasks as there are groups.
GROUP = 32_768
#: Rows of either side of one product within a task: 16 MB of float32.
BLOCK = 2_048


def exact_groups(photos: DataFrame, key: str = "sha256_hash") -> DataFrame:
    """Members of every digest that several photos share, with their position by taken_at and path."""
    shared = photos.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = photos.join(shared, key)
    order = W.partitionBy(key).orderBy(F.asc_nulls_first("taken_at"), "path")
    return members.withColumn("pos", F.row_number().over(order)).withColumn("group_type", F.lit("exact"))


def keep_best(groups: DataFrame, key: str) -> DataFrame:
    """``groups`` with score and delete: all but the highest score of a group, ties keep the earlier position; old marks stay."""
    scored = groups.withColumn("score", X.quality_score(F.col("width"), F.col("height"), F.col("size_bytes"), F.col("taken_at")))
    order = W.partitionBy(key).orderBy(F.desc("score"), "pos")
    return scored.withColumn("delete", (F.row_number().over(order) > 1) | F.coalesce("marked_for_deletion", F.lit(False)))


def mark_identical(groups: DataFrame, key: str) -> DataFrame:
    """Members of exact groups to mark newly: all but the lowest name score, that are not marked yet."""
    scored = groups.where("group_type = 'exact'").withColumn("score", X.filename_score(F.col("path"), F.col("filename")))
    order = W.partitionBy(key).orderBy("score", "pos")
    return scored.withColumn("r", F.row_number().over(order)).where("r > 1 AND NOT coalesce(marked_for_deletion, false)").drop("r")


def remove_members(groups: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``groups`` without some photos, and without the groups that then have fewer than two."""
    left = groups.join(ids.select("id"), "id", "left_anti")
    return left.withColumn("_n", F.count("*").over(W.partitionBy(key))).where("_n >= 2").drop("_n")


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, leader): greedy leader grouping in order of pos, without looping over rows.

    ``edges``: i < j. A node with no earlier neighbour that leads or is undecided leads; one with an earlier neighbour that
    leads joins the first such; repeat until all are decided. Equal to the sequential loop. Rounds are as many as the longest
    chain of decisions; each is one join and one aggregation over the undecided part.
    """
    state = cut(nodes.select("pos", F.lit(None).cast("boolean").alias("leads")))
    edges = cut(edges.select("i", "j").distinct())
    undecided = state.count()
    while undecided:
        before = edges.join(state.select(F.col("pos").alias("i"), F.col("leads").alias("li")), "i")
        seen = before.groupBy("j").agg(F.max(F.coalesce("li", F.lit(False))).alias("led"), F.max(F.col("li").isNull()).alias("waits"))
        state = cut(
            state.join(seen.withColumnRenamed("j", "pos"), "pos", "left")
            .select("pos", F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True).alias("leads"))
        )
        undecided = state.where("leads IS NULL").count()
    lead = state.where("leads").select(F.col("pos").alias("i"))
    joined = edges.join(lead, "i").groupBy(F.col("j").alias("pos")).agg(F.min("i").alias("first"))
    return state.join(joined, "pos", "left").select("pos", F.when(F.col("leads"), F.col("pos")).otherwise(F.col("first")).alias("leader"))


def _block_pairs(rows: DataFrame, unpack: Callable[[pa.ChunkedArray], np.ndarray], compare: Callable[[np.ndarray, np.ndarray], tuple], name: str, kind: str) -> DataFrame:
    """(i, j, ``name``) of all pairs i < j of ``rows`` (pos, x) that ``compare`` keeps, by block matrix products.

    ``unpack`` makes a matrix of the values of x, and ``compare`` gives (row, column, value) of the pairs to keep of two
    matrices. Rows are dealt into groups of about ``GROUP``; each pair of groups is one task, so the tasks and the copies of
    the rows grow with the square of their number.
    """
    rows = cut(rows.where("pos IS NOT NULL AND x IS NOT NULL"))
    groups = max(-(-rows.count() // GROUP), 3)
    g = F.pmod(F.xxhash64("pos"), F.lit(groups)).cast("int")
    keyed = rows.select("pos", "x", g.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h"))
    keyed = keyed.select("pos", "x", "g", F.least("g", "h").alias("lo"), F.greatest("g", "h").alias("hi"))

    def task(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        pos, side = table.column("pos").to_numpy(), table.column("g").to_numpy()
        x = unpack(table.column("x"))
        first, second = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for s in range(0, len(first), BLOCK):
            at = first[s : s + BLOCK]
            for t in range(s if lo == hi else 0, len(second), BLOCK):
                to = second[t : t + BLOCK]
                row, column, value = compare(x[at], x[to])
                a, b = pos[at[row]], pos[to[column]]
                keep = a < b if lo == hi and s == t else a != b
                parts.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], value[keep]))
        i, j, value = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.table({"i": i, "j": j, name: value.astype(np.int32) if kind == "int" else value})

    tasks = groups * (groups + 1) // 2
    return keyed.repartition(max(2 * tasks, 8), "lo", "hi").groupBy("lo", "hi").applyInArrow(task, f"i bigint, j bigint, {name} {kind}")


def _apart(threshold: int) -> Callable[[np.ndarray, np.ndarray], tuple]:
    def compare(a: np.ndarray, b: np.ndarray) -> tuple:
        # bits as +1 and -1: the product is 256 less twice the differing bits, exact in float32
        product = a @ b.T
        row, column = np.divmod(np.flatnonzero(product >= 256 - 2 * threshold), len(b))
        return row, column, (256 - product[row, column]) / 2

    return compare


def _signs(column: pa.ChunkedArray) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)
    return np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1


def hamming_edges(photos: DataFrame, threshold: int) -> DataFrame:
    """(i, j, distance) of photos with pos, in order of pos, whose hashes differ in at most ``threshold`` of 256 bits.

    Up to 16 bits the pairs come from bands that must agree up to one bit; above, no band prunes enough, and the join is a
    comparison of all pairs, as the rule defines it, by block products of the bits.
    """
    if threshold > 16:
        return _block_pairs(photos.select("pos", F.col("bits").alias("x")), _signs, _apart(threshold), "distance", "int")
    words = photos.select("pos", H.words64(F.col("bits")).alias("w"))
    hexed = photos.select("pos", F.hex("bits").alias("x"))
    # 17 pieces of 15 or 16 bits: at most 16 differing bits leave one piece equal
    binary = hexed.select("pos", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.lpad(F.conv(F.substring("x", k * 4 + 1, F.lit(4)), 16, 2), 16, "0")), "").alias("b"))
    edges = [256 * k // 17 for k in range(18)]
    pieces = binary.select("pos", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.substring("b", edges[k] + 1, edges[k + 1] - edges[k]).alias("piece")) for k in range(17)))))
    pairs = pieces.alias("a").join(pieces.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.pos") < F.col("b.pos")))
    pairs = pairs.select(F.col("a.pos").alias("i"), F.col("b.pos").alias("j")).distinct()
    left, right = words.select(F.col("pos").alias("i"), F.col("w").alias("wi")), words.select(F.col("pos").alias("j"), F.col("w").alias("wj"))
    found = pairs.join(left, "i").join(right, "j")
    return found.withColumn("distance", H.hamming(F.col("wi"), F.col("wj"))).where(F.col("distance") <= threshold).select("i", "j", "distance")


def similar_vectors(vectors: DataFrame, least: float) -> DataFrame:
    """(i, j, similarity) of all pairs i < j of (pos, x) whose cosine, to six decimals, is at or above ``least``.

    ``least`` is above 0, so vectors of different lengths and zero vectors are in no pair; vectors with null or non-finite
    numbers are left out.
    """
    x = F.col("x").cast("array<double>")
    good = (F.size("x") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = cut(vectors.where(good).select("pos", x.alias("x")))
    parts = [rows.where(F.size("x") == r["n"]) for r in rows.select(F.size("x").alias("n")).distinct().collect()]  # as many as lengths

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        raw = column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)
        return raw / np.linalg.norm(raw, axis=1, keepdims=True)

    def compare(a: np.ndarray, b: np.ndarray) -> tuple:
        value = np.round(a @ b.T, 6)
        row, column = np.nonzero(value >= least)
        return row, column, value[row, column]

    found = [_block_pairs(p, matrix, compare, "similarity", "double") for p in parts]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "i bigint, j bigint, similarity double")


def with_positions(photos: DataFrame) -> DataFrame:
    """Photos with a readable hash and their rank by path, from counts of range partitions rather than a global window."""
    from heliograph.catalog import assign_ids

    rows = photos.withColumn("bits", H._bytes32(F.regexp_replace("perceptual_hash", r"\s+", ""))).where("bits IS NOT NULL")
    return assign_ids(rows.drop("pos"), rows.where(F.lit(False)).select(F.lit(0).cast("bigint").alias("pos")), ["path"], "pos")


def perceptual_groups(photos: DataFrame, threshold: int) -> DataFrame:
    """Members of the leader groups of at least two photos, with group_id (the leader's id) and group_type."""
    placed = with_positions(photos.select("id", "path", "perceptual_hash"))
    led = cut(leaders(placed.select("pos"), hamming_edges(placed, threshold)))
    heads = placed.select(F.col("pos").alias("leader"), F.col("id").alias("group_id"))
    members = placed.select("id", "pos").join(led, "pos").join(heads, "leader")
    several = led.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").select("leader")
    members = members.join(several, "leader", "left_semi").select("id", "pos", "group_id")
    return photos.drop("pos").join(members, "id").withColumn("group_type", F.lit("perceptual"))


def box_leaders(boxes: DataFrame, threshold: float, key: str = "photo_id") -> DataFrame:
    """Non-maximum suppression per image: by confidence, keep a box unless its overlap with a kept one exceeds ``threshold``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["confidence", "id"], ascending=[False, True], na_position="last")
        x, y, w, h = (rows[f"bbox_{c}"].to_numpy(np.float64) for c in "xywh")
        open_, kept = np.ones(len(rows), bool), []
        for i in range(len(rows)):
            if open_[i]:
                kept.append(i)
                both = np.maximum(0, np.minimum(x[i] + w[i], x + w) - np.maximum(x[i], x)) * np.maximum(0, np.minimum(y[i] + h[i], y + h) - np.maximum(y[i], y))
                union = w[i] * h[i] + w * h - both
                open_ &= ~((union > 0) & (both > threshold * union))
        return rows.iloc[kept][[key, "id"]]

    return boxes.groupBy(key).applyInPandas(run, f"{key} bigint, id bigint")
