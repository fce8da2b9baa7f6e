"""Versioned Parquet snapshots of the catalogue, id assignment and referential actions.

A change is a DataFrame-to-DataFrame step; ``commit`` writes the new snapshot beside the old one and only then moves the
pointer, so a reader or a failed writer never sees half a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.runtime import cut
from heliograph.schema import KEYS, REFERENCES, SCHEMAS, conform


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self, name: str) -> int:
        """The newest complete version of a table, 0 if it was never written."""
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        done = [int(n[1:]) for n in names if n.startswith("v") and self._fs.exists(self._path(f"{self.root}/{name}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def table(self, name: str) -> DataFrame:
        v = self.version(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{v}") if v else self.spark.createDataFrame([], SCHEMAS[name])

    def commit(self, name: str, df: DataFrame) -> int:
        v = self.version(name) + 1
        conform(df, name).write.mode("overwrite").parquet(f"{self.root}/{name}/v{v}")
        return v

    def delete(self, name: str, ids: DataFrame) -> None:
        """Delete the rows of ``name`` whose id is in ``ids`` (column id), with every action that follows from it."""
        for child, change in cascade(name, ids, self.table).items():
            self.commit(child, change)


def assign_ids(fresh: DataFrame, existing: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """``fresh`` with ids above the largest of ``existing``, dense in ``order``.

    Ranks come from counts of range partitions, not from one global window: the rows are sorted across partitions and each
    adds the number of rows before its partition. The sorted rows are written first: a second run may have other partitions.
    """
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    sorted_ = cut(fresh.drop(key).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = {r["_p"]: r["n"] for r in sorted_.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    base, offsets = 0, {}
    for p in sorted(sizes):
        offsets[p], base = base, base + sizes[p]
    first = F.create_map(*(F.lit(x) for p, o in offsets.items() for x in (p, o))) if offsets else F.create_map(F.lit(0), F.lit(0))
    local = F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33)
    ranked = sorted_.withColumn(key, F.element_at(first, F.col("_p")) + local + 1).drop("_p", "_m")
    return ranked.join(F.broadcast(top), F.lit(True)).withColumn(key, (F.col(key) + F.col("top")).cast("bigint")).drop("top")


def cascade(name: str, ids: DataFrame, table) -> dict[str, DataFrame]:
    """Every table that changes when the rows ``ids`` (column id) of ``name`` go: children lose their rows or their reference."""
    gone = {name: ids.select("id").distinct()}
    out: dict[str, DataFrame] = {}
    queue = [name]
    while queue:
        parent = queue.pop(0)
        own = out.get(parent, table(parent))
        if parent == name or "id" in KEYS[parent]:
            out[parent] = own.join(gone[parent], "id", "left_anti")
        for child, column, above, action in REFERENCES:
            if above != parent:
                continue
            rows = out.get(child, table(child))
            dead = gone[parent].select(F.col("id").alias(column))
            if action == "set null":
                marked = rows.join(dead.withColumn("_dead", F.lit(True)), column, "left")
                out[child] = marked.withColumn(column, F.when(F.col("_dead").isNull(), F.col(column))).select(*rows.columns)
            else:
                if "id" in rows.columns:
                    more = rows.join(dead, column, "left_semi").select("id")
                    gone[child] = more if child not in gone else gone[child].unionByName(more).distinct()
                    queue.append(child)
                out[child] = rows.join(dead, column, "left_anti")
    return out
