"""Sinks for the catalogue's export rows: JSON, CSV and HTML, and a copy of one catalogue into another."""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from heliograph.functions import exprs as X
from heliograph.operators.lookups import export_rows
from heliograph.runtime import seen_by
from heliograph.schema import KEYS, PARENTS_FIRST, conform


def _in_order(rows: DataFrame, keys: list[str], seen: Observation | None) -> DataFrame:
    """Ranges of ``rows`` in order of ``keys``, to be written in parallel; counted after the ranges are drawn, which reads them too."""
    held = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return held if seen is None else held.observe(seen, F.count(F.lit(1)).alias("n"))


def write_json(photos: DataFrame, path: str, seen: Observation | None = None) -> None:
    """JSON lines in order of path, nulls kept; ranges are written in parallel."""
    _in_order(export_rows(photos), ["path"], seen).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(photos: DataFrame, path: str, seen: Observation | None = None) -> None:
    _in_order(export_rows(photos), ["path"], seen).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def html_card() -> Column:
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"<p>{label}: "), X.html_escape(c), F.lit("</p>"))).otherwise("")
    return F.concat(
        F.lit('<div class="card"><h2>'), X.html_escape(F.col("filename")), F.lit("</h2>"), line("Path", F.col("path")), line("Size", X.size_text(F.col("size_bytes"))), line("Taken", F.col("taken_at")),
        line("Camera", F.concat_ws(" ", "camera_make", "camera_model")), line("Description", F.col("description")), line("Tags", F.col("tags")), F.lit("</div>"),
    )


def html_rows(photos: DataFrame) -> DataFrame:
    """(path, value): one escaped card a photo."""
    return export_rows(photos).select("path", html_card().alias("value"))


def write_html(photos: DataFrame, path: str, title: str = "Photos", seen: Observation | None = None) -> None:
    """Cards in order of path between a head with the total and a foot, as text files in order."""
    rows = html_rows(photos)
    total = rows.count()
    spark = photos.sparkSession
    head = spark.createDataFrame([(0, "", f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title></head><body><h1>{total} photos</h1>")], "k int, path string, value string")
    foot = spark.createDataFrame([(2, "", "</body></html>")], "k int, path string, value string")
    every = head.unionByName(rows.select(F.lit(1).alias("k"), "path", "value")).unionByName(foot)
    held = _in_order(every, ["k", "path"], None)
    held = held if seen is None else held.observe(seen, F.count(F.when(F.col("k") == 1, 1)).alias("n"))
    held.select("value").write.mode("overwrite").text(path)


def copy_missing(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a table that another catalogue lacks, ids kept."""
    return source.join(target.select(*keys), keys, "left_anti")


def export(photos: DataFrame, path: str, kind: str) -> int:
    """Write all photos in order of path as json, csv or html; the number of photos. It is counted while they are written."""
    observation = Observation()
    {"json": write_json, "csv": write_csv, "html": write_html}[kind](photos, path, seen=observation)
    return seen_by(observation).get("n", 0)


def copy_catalogue(source, target) -> dict[str, int]:
    """Copy into a catalogue what it lacks of another one, table by table, parents first; (rows copied) of each table.

    Both have ``table`` and ``commit`` as ``Catalog``. Ids are kept; columns get the types of the target's schema.
    """
    copied = {}
    for name in PARENTS_FIRST:
        fresh = copy_missing(conform(source.table(name), name), target.table(name), KEYS[name])
        copied[name] = fresh.count()
        if copied[name]:
            target.commit(name, target.table(name).unionByName(fresh))
    return copied


def watermarks(catalogue) -> DataFrame:
    """(table_name, top): the largest id of each table that has ids, 0 for an empty one; new ids begin above it."""
    tops = [catalogue.table(n).agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).select(F.lit(n).alias("table_name"), "top") for n in PARENTS_FIRST if KEYS[n] == ["id"]]
    return reduce(DataFrame.unionByName, tops)
