"""Average-linkage clusters by nearest-neighbour chains within components.

A cluster is kept as its number of members and their mean unit vector; the mean cosine between the members of two clusters
is the product of their means, so average linkage never needs the pairs. The block matrix join finds the components of the
graph of all pairs that reach the least similarity. Vectors of different components never merge, since every cosine between
them, and so every mean of such cosines, is below it.

A component of any size is clustered in one task. Merging clusters that are each other's best partner gives the clusters of
the sequential method, which merges the best pair of all first, since average linkage never brings a merged cluster closer to
a third than its parts were. A chain that steps from a cluster to its best partner ends at such a pair. The task holds the
component's means, not its similarities; its time grows with the square of the component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograph.llm.components import core_components
from heliograph.llm.vectors import DIMENSIONS, SENT, floats, similar_pairs, units
from heliograph.runtime import cut, cut_small, release

LEAST = 0.7
#: The square root of the similarities that a task computes at once: 34 MB.
PART = 2048
#: Decimals by which similarities are compared.
DIGITS = 12


def merge_reciprocal(ids: np.ndarray, n: np.ndarray, mean: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head of each cluster, counts, means) after all rounds; the head is the smallest id and carries the merged figures."""
    order = np.argsort(ids)  # by id, so that ties go to the smaller one
    n, mean = n[order].astype(np.int64), mean[order].astype(np.float64)
    head, alive = np.arange(len(ids)), np.ones(len(ids), bool)
    best, value = np.zeros(len(ids), np.int64), np.full(len(ids), -2.0)
    rows = max(1, PART * PART // max(1, len(ids)))
    for start in range(0, len(ids), rows):
        s = np.round(mean[start : start + rows] @ mean.T, DIGITS)
        own = np.arange(len(s))
        s[own, own + start] = -2
        best[start : start + rows] = s.argmax(axis=1)
        value[start : start + rows] = s[own, best[start : start + rows]]
    # a best partner holds until it merges, as no other comes closer by merging
    merged, looked = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    clock = 0
    for start in range(len(ids)):
        chain = [start] if alive[start] else []
        while chain:
            x = chain[-1]
            if merged[best[x]] > looked[x]:
                s = np.round(mean @ mean[x], DIGITS)
                s[~alive], s[x] = -2, -2
                best[x] = s.argmax()
                value[x], looked[x] = s[best[x]], clock
            if value[x] < least:
                break  # of the first only: from link to link values rise
            if len(chain) == 1 or value[x] > value[chain[-2]] + 10.0 ** (1 - DIGITS):
                chain.append(int(best[x]))
                continue
            a, b = sorted(chain[-2:])
            chain[-2:] = []
            mean[a] = (n[a] * mean[a] + n[b] * mean[b]) / (n[a] + n[b])
            n[a] += n[b]
            clock += 1
            head[b], alive[b], merged[a], merged[b], looked[a], best[a] = a, False, clock, clock, -1, b
            chain = chain or [a]
    while (head[head] != head).any():
        head = head[head]
    back = np.empty(len(ids), np.int64)
    back[order] = np.arange(len(ids))
    return order[head[back]], n[back], mean[back].astype(np.float32)


def _unique(vectors: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """((id, n, u) of different unit vectors, (id, lead) of all ids): of n equal vectors the smallest id leads.

    Copies are found by a digest, so that the vectors themselves are not shuffled.
    """
    held = cut(units(vectors, dimensions).withColumn("h", F.unhex(F.md5("u"))))
    marks = held.select("id", "h").groupBy("id").agg(F.min("h").alias("h"), F.count("*").alias("rows"))  # a repeated id counts once
    leads = marks.groupBy("h").agg(F.min("id").alias("lead"), F.count("*").alias("n"))
    member = cut(marks.join(leads, "h").select("id", "lead", "h", "n", "rows"))
    chosen = member.where("id = lead").select("id", "h")
    others = cut_small(held.select("id", "h").join(chosen, ["id", "h"], "left_anti").distinct())
    copied = cut_small(member.where("id = lead AND n > 1").select("id", "n"))
    repeated = cut_small(member.where("rows > 1").select("id"))
    own = held.join(others, ["id", "h"], "left_anti").select("id", "u").join(copied, "id", "left").select("id", F.coalesce("n", F.lit(1).cast("bigint")).alias("n"), "u")
    once = own if repeated.isEmpty() else own.join(repeated, "id", "left_anti").unionByName(own.join(repeated, "id", "left_semi").dropDuplicates(["id"]))
    return cut(once), member.select("id", "lead")


def _merge(nodes: DataFrame, least: float, dimensions: int) -> DataFrame:
    """(id, head, n, u) for ``nodes`` (id, n, u, component): merged within each component; n and u are null for non-heads."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        head, n, mean = merge_reciprocal(ids, table.column("n").to_numpy(), floats(table.column("u"), dimensions), least)
        own = head == np.arange(len(ids))
        return pa.table(
            {"id": ids, "head": ids[head], "n": pa.array(n, mask=~own), "u": pa.array([m.tobytes() if o else None for m, o in zip(mean, own, strict=True)], pa.binary())}
        )

    return nodes.groupBy("component").applyInArrow(run, "id bigint, head bigint, n bigint, u binary")


def cluster(vectors: DataFrame, least: float = LEAST, dimensions: int = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """(membership, clusters) of (id, vector).

    membership: id, cluster, for every usable vector (just ``dimensions`` finite numbers, not all zero); the cluster is the
    smallest id of its members. clusters: cluster, size, u (mean unit vector as float32 bytes). Other vectors and null ids
    take no part, repeated ids count once, an empty table gives two empty results. In the end no two clusters have a mean
    cosine of ``least`` or more; ties go to smaller ids. Equal vectors are one cluster from the start.
    """
    spark = vectors.sparkSession
    nodes, member = _unique(vectors, dimensions)
    release(spark)
    graph = similar_pairs(nodes.select(F.lit("").alias("kind"), "id", "u"), least, 1, dimensions, digits=DIGITS, forest=True)
    release(spark)
    parts = cut_small(core_components(graph.select(F.col("id").alias("a"), F.col("partner").alias("b"))).withColumnRenamed("vertex", "id"), SENT)
    release(spark)
    merged = cut(_merge(nodes.join(parts, "id").select("id", "n", "u", "component"), least, dimensions))
    heads = merged.where("id != head").select(F.col("id").alias("gone"), "head")
    # a vector without a partner now has none for ever
    ends = merged.where("id = head").select("id", "n", "u").unionByName(nodes.join(parts, "id", "left_anti").select("id", "n", "u"))
    clusters = ends.select(F.col("id").alias("cluster"), F.col("n").alias("size"), "u")
    return member.join(heads, F.col("lead") == F.col("gone"), "left").select("id", F.coalesce("head", "lead").alias("cluster")), clusters


def describe(vectors: DataFrame, membership: DataFrame, clusters: DataFrame, typical: int = 3, dimensions: int = DIMENSIONS) -> DataFrame:
    """(cluster, size, representative, typical): the members closest to each cluster's mean; ties go to the smaller id."""

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                value = np.einsum("ij,ij->i", floats(batch.column(2), dimensions), floats(batch.column(3), dimensions))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(value.astype(np.float64), 6))], names=["id", "cluster", "value"])

    joined = units(vectors, dimensions).groupBy("id").agg(F.min("u").alias("u")).join(membership, "id").join(clusters.select("cluster", F.col("u").alias("mean")), "cluster")
    scored = joined.select("id", "cluster", "u", "mean").mapInArrow(score, "id bigint, cluster bigint, value double")
    # the best of each partition of a cluster first, so that a large cluster is never sorted in one task
    salted = W.partitionBy("cluster", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy(F.desc("value"), "id")
    few = scored.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= typical).drop("r")
    few = few.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("value"), "id"))).where(F.col("r") <= typical)
    best = few.groupBy("cluster").agg(F.min(F.when(F.col("r") == 1, F.col("id"))).alias("representative"), F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
    return clusters.select("cluster", "size").join(best, "cluster")
