"""Connected components by rake and compress.

Each round strips the vertices of degree one (each hangs on its neighbour) and contracts every chain of degree-two vertices
to one edge by list ranking, so paths and trees vanish in a logarithmic number of rounds. What remains has only vertices of
degree three and more; this core is solved by minimum labels with pointer jumping. The removed vertices form a forest above
the core and get their labels back in the reverse order of removal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.runtime import cut


def _simple(edges: DataFrame) -> DataFrame:
    """Undirected edges a < b, once each, without loops."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))))


def _strip(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents of the vertices of degree one, the edges without them). Of a lone edge the smaller end stays."""
    ends = _both(edges).groupBy("v").agg(F.count("*").alias("degree"), F.min("w").alias("w"))
    leaves = ends.where("degree = 1").select("v", F.col("w").alias("parent"))
    other = leaves.select(F.col("v").alias("parent"), F.col("parent").alias("back"))
    hung = cut(leaves.join(other, "parent", "left").where("back IS NULL OR back != v OR v > parent").select("v", "parent"))
    left = edges.join(hung.select(F.col("v").alias("a")), "a", "left_anti").join(hung.select(F.col("v").alias("b")), "b", "left_anti")
    return hung, left


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents of the vertices of degree two, the edges with every chain of them contracted).

    An arc u -> v with v inside a chain is followed by the arc v -> w to the other neighbour. Doubling finds for each arc
    the arc that ends its chain and the smallest vertex on the way; rings have no end and take their smallest vertex.
    """
    ends = _both(edges).groupBy("v").agg(F.count("*").alias("degree"), F.min("w").alias("x"), F.max("w").alias("y"))
    inner = cut(ends.where("degree = 2").select("v", "x", "y"))
    if inner.isEmpty():
        return inner.select("v", F.col("x").alias("parent")), edges
    # arcs into inner vertices: from one neighbour, leading on to the other
    arcs = inner.select(F.inline(F.array(F.struct(F.col("x").alias("u"), "v", F.col("y").alias("w")), F.struct(F.col("y").alias("u"), "v", F.col("x").alias("w")))))
    goes_on = inner.select(F.col("v").alias("w"), F.lit(True).alias("more"))
    # (u, v): first arc; (tail, head): last arc reached; low: smallest inner vertex from v to tail
    state = cut(
        arcs.join(goes_on, "w", "left").select("u", "v", F.col("v").alias("tail"), F.col("w").alias("head"), F.col("v").alias("low"), F.col("more").isNull().alias("ended"))
    )
    while True:
        ahead = state.select(F.col("u").alias("tail"), F.col("v").alias("head"), F.col("tail").alias("t2"), F.col("head").alias("h2"), F.col("low").alias("low2"), F.col("ended").alias("e2"))
        # arcs that have ended need no look-up, so a hub where many chains end is no hot key
        done = state.where("ended").withColumn("moved", F.lit(False))
        going = state.where("NOT ended").join(ahead, ["tail", "head"]).select(
            "u", "v", F.col("t2").alias("tail"), F.col("h2").alias("head"), F.least("low", "low2").alias("low"), F.col("e2").alias("ended"), (F.col("e2") | (F.col("low2") < F.col("low"))).alias("moved")
        )
        step = cut(done.unionByName(going))
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    chains = state.where("ended").groupBy("v").agg(F.min("head").alias("parent"), F.max("head").alias("far"), F.min("low").alias("low"))
    rings = state.where("NOT ended").groupBy("v").agg(F.min("low").alias("parent")).where("v != parent")
    hung = chains.select("v", "parent").unionByName(rings)
    joined = chains.groupBy(F.col("parent").alias("a"), F.col("far").alias("b")).agg(F.count("*").alias("n")).select("a", "b")
    gone = inner.select("v")
    left = edges.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti")
    return cut(hung), _simple(left.unionByName(joined))


def _core(edges: DataFrame) -> DataFrame:
    """(v, label) of the reduced core: smallest label of the neighbourhood, then of the label's own label, until nothing moves."""
    arcs = cut(_both(edges))
    labels = cut(arcs.groupBy("v").agg(F.min("w").alias("low")).select("v", F.least("v", "low").alias("label")))
    while True:
        near = arcs.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        step = cut(hooked.join(jump, "label", "left").select("v", F.coalesce(F.least("label", "further"), F.col("label")).alias("label"), "old"))
        labels = step.select("v", "label")
        if step.where("label < old").isEmpty():
            return labels


def core_components(edges: DataFrame) -> DataFrame:
    """``connected_components`` of graphs that are dense throughout, where stripping would remove next to nothing."""
    todo = cut(_simple(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))))
    return _core(todo).select(F.col("v").alias("vertex"), F.col("label").alias("component"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component): every vertex with an edge to another one, and the smallest vertex of its component.

    ``edges``: columns a and b (bigint). Rows with a null end, loops and repeated edges change nothing; a vertex that only
    has such rows is not in the result. An empty table gives an empty result. Further columns are ignored.
    """
    spark = edges.sparkSession
    todo = cut(_simple(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))))
    removed: list[DataFrame] = []
    while not todo.isEmpty():
        leaves, left = _strip(todo)
        chained, left = _compress(cut(left))
        found = [x for x in (leaves, chained) if not x.isEmpty()]
        todo = cut(left)
        removed += found
        if not found:
            break
    labels = spark.createDataFrame([], "v bigint, label bigint") if todo.isEmpty() else _core(todo)
    for hung in reversed(removed):
        above = hung.join(labels.select(F.col("v").alias("parent"), "label"), "parent", "left").select("v", F.coalesce("label", "parent").alias("label"))
        # a parent that is in no later round is the root of its component
        roots = hung.select(F.col("parent").alias("v")).distinct().join(labels.select("v"), "v", "left_anti").select("v", F.col("v").alias("label"))
        labels = reduce(DataFrame.unionByName, [labels, above, roots])
        labels = cut(labels)
    lows = labels.groupBy("label").agg(F.min("v").alias("component"))
    return labels.join(lows, "label").select(F.col("v").alias("vertex"), "component")
