"""Change detection, scan upsert, retention, library organisation and reply parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograph.functions import exprs as X
from heliograph.runtime import cut

#: Seconds by which a file must be newer than its row to count as modified.
TOLERANCE_S = 2
#: Positions of a block of ``_running``.
BLOCK = 100_000


def detect_changes(listing: DataFrame, photos: DataFrame) -> DataFrame:
    """(path, change) of files that are new, or newer than their row by more than two seconds.

    ``listing``: path, mtime (timestamp). A row without a readable time counts as older; files that went are not reported.
    """
    held = photos.select("path", F.try_to_timestamp("modified_at", F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("_db"), F.lit(True).alias("_known"))
    age = F.unix_timestamp("mtime") - F.unix_timestamp("_db")
    change = F.when(F.col("_known").isNull(), "new").when(F.col("_db").isNull() | (age > TOLERANCE_S), "modified")
    return listing.join(held, "path", "left").select("path", change.alias("change")).where("change IS NOT NULL")


def files_to_rescan(changes: DataFrame, selected: list[str] | None = None) -> DataFrame:
    return changes.select("path") if selected is None else changes.where(F.col("path").isin(selected)).select("path")


def scan_actions(scanned: DataFrame, photos: DataFrame) -> DataFrame:
    """(path, action): whether a scanned file inserts or updates; one join instead of a look-up a file."""
    known = photos.select("path", F.lit("update").alias("action"))
    return scanned.select("path").join(known, "path", "left").withColumn("action", F.coalesce("action", F.lit("insert")))


def retention(files: DataFrame, now_s: int, max_age_s: int, max_bytes: int, partitions: int | None = None) -> DataFrame:
    """The files to delete: those older than ``max_age_s``, then the oldest while the rest exceeds ``max_bytes``.

    ``files``: path, mtime_s, size. Running totals come in two steps, within ranges of age and over the ranges' sums, so the
    whole trash is never sorted in one task. The ranges are written before they are counted: a second run may draw others.
    """
    aged = files.withColumn("expired", F.col("mtime_s") < now_s - max_age_s)
    ranges = ["mtime_s", "path"] if partitions is None else [partitions, "mtime_s", "path"]
    kept = cut(aged.where("NOT expired").repartitionByRange(*ranges).withColumn("_p", F.spark_partition_id()))
    sums = kept.groupBy("_p").agg(F.sum("size").alias("_s"))
    offsets = sums.select("_p", (F.sum("_s").over(W.orderBy("_p")) - F.col("_s")).alias("_before"))  # one row a range
    total = sums.agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("_total"))
    own = F.coalesce(F.sum("size").over(W.partitionBy("_p").orderBy("mtime_s", "path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    running = kept.join(F.broadcast(offsets), "_p").join(F.broadcast(total), F.lit(True)).withColumn("_own", own)
    large = running.where(F.col("_total") - F.col("_before") - F.col("_own") > max_bytes)
    columns = [c for c in files.columns]
    return aged.where("expired").select(*columns, F.lit("age").alias("reason")).unionByName(large.select(*columns, F.lit("size").alias("reason")))


def cleanup_totals(deleted: DataFrame) -> DataFrame:
    return deleted.agg(F.count("*").alias("files_deleted"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_freed"))


def trash_name(filename: Column, epoch: int, seq: Column) -> Column:
    ext = F.regexp_extract(filename, r".(\.[^.]*)$", 1)
    return F.concat(X.stem(filename), F.lit(f"_{epoch}_"), seq.cast("string"), ext)


def filename_parts(photos: DataFrame, people: str = "people") -> DataFrame:
    """``photos`` with the parts of an organised name: p_date, p_time, p_event, p_people, p_brief, p_ext, p_stem."""
    taken = X.taken_time(F.col("taken_at"))
    ext = X.extension(F.col("path"))
    return photos.withColumns(
        {
            "p_date": F.date_format(taken, "yyyyMMdd"), "p_time": F.date_format(taken, "HHmm"), "p_event": X.event(F.col("tags"), F.col("description")),
            "p_people": F.nullif(F.array_join(F.transform(F.col(people), X.sanitise), "-"), F.lit("")) if people in photos.columns else F.lit(None).cast("string"),
            "p_brief": X.brief(F.col("description")), "p_ext": F.when(ext == "", "jpg").otherwise(ext), "p_stem": X.stem(F.col("filename")),
        }
    )


def render_filename(count: Column, longest: int = 100) -> Column:
    """The organised name from the columns of ``filename_parts`` and a counter."""
    when = F.when(F.col("p_time").isNotNull() & F.col("p_date").isNotNull(), F.concat_ws("-", "p_date", "p_time")).otherwise(F.col("p_date"))
    parts = F.filter(F.array(when, F.col("p_event"), F.col("p_people"), F.col("p_brief")), lambda x: x.isNotNull() & (x != ""))
    bare = (F.size(parts) == 0) | ((F.size(parts) == 1) & F.col("p_date").isNull())
    chosen = F.when(bare, F.array(F.lit(X.NO_CATEGORY), X.sanitise(F.col("p_stem")))).otherwise(parts)
    name = F.concat(F.array_join(chosen, "_"), F.lit("_"), F.format_string("%03d", count.cast("bigint")))
    room = longest - F.length("p_ext") - 1
    cut = F.when(F.length(name) > room, F.regexp_replace(F.substring(name, F.lit(1), room), "[_-]+$", "")).otherwise(name)
    return F.concat(cut, F.lit("."), F.col("p_ext"))


def _running(df: DataFrame, by: str, order: str, value: Column, fold, backwards: bool = False) -> DataFrame:
    """``df`` with ``running``: ``fold`` of ``value`` over the rows of ``by`` up to each one in ``order`` (from it on, if backwards).

    Folded within blocks of positions and over the blocks, so that a key that holds most rows is never sorted in one task.
    """
    blocked = df.withColumns({"_b": F.floor(F.col(order) / BLOCK), "_v": value})
    direction = (lambda c: F.desc(c)) if backwards else F.asc
    within = fold("_v").over(W.partitionBy(by, "_b").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, W.currentRow))
    totals = blocked.groupBy(by, "_b").agg(fold("_v").alias("_t"))
    before = totals.select(by, "_b", fold("_t").over(W.partitionBy(by).orderBy(direction("_b")).rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    both = blocked.withColumn("_own", within).join(before, [by, "_b"])
    pair = F.array_compact(F.array("_own", "_before"))
    return both.withColumn("running", F.aggregate(pair, F.lit(0).cast("bigint"), lambda x, y: x + y) if fold is F.sum else F.array_min(pair)).drop("_b", "_v", "_own", "_before")


def organise(photos: DataFrame, root: str, longest: int = 100) -> DataFrame:
    """(id, path, destination) of a dry run: files get dated names in dated folders, and a counter on conflict.

    Within a folder files come in order of path. The counter is a high-water mark: it starts at 1, is shared by the folder
    and rises only when a planned name is taken. So a folder falls into runs of different names, and a run ends where a name
    first recurs in it. Where a run that began at a position would end is the least next occurrence of a name from there on;
    following those ends by pointer doubling marks the runs, and the counter is the number of the run.
    """
    from heliograph.catalog import assign_ids

    parts = filename_parts(photos).withColumn("folder", X.destination_folder(F.lit(root), F.col("taken_at"))).where(~X.under(F.col("path"), root))
    named = parts.withColumn("name1", render_filename(F.lit(1), longest)).select("id", "path", "folder", "p_ext", F.expr("substring(name1, 1, length(name1) - length(p_ext) - 4)").alias("base"))
    placed = cut(assign_ids(named, named.where(F.lit(False)).select(F.lit(0).cast("bigint").alias("pos")), ["folder", "path"], "pos"))
    again = placed.withColumn("next", F.lead("pos").over(W.partitionBy("folder", "base", "p_ext").orderBy("pos"))).select("folder", "pos", "next")
    ends = _running(again, "folder", "pos", F.col("next"), F.min, backwards=True).where("running IS NOT NULL").select("pos", F.col("running").alias("to"))
    jump = cut(ends)
    reached = cut(placed.groupBy("folder").agg(F.min("pos").alias("pos")).select("pos"))
    begun = [reached]
    while True:
        more = cut(reduce(DataFrame.unionByName, begun).join(jump, "pos").select(F.col("to").alias("pos")).distinct())
        if more.isEmpty():
            break
        begun.append(more)
        jump = cut(jump.join(jump.select(F.col("pos").alias("to"), F.col("to").alias("further")), "to").select("pos", F.col("further").alias("to")))
    starts = reduce(DataFrame.unionByName, begun).distinct().withColumn("start", F.lit(1).cast("bigint"))
    counted = _running(placed.join(starts, "pos", "left"), "folder", "pos", F.coalesce("start", F.lit(0).cast("bigint")), F.sum)
    return counted.select("id", "path", F.concat("folder", F.lit("/"), "base", F.format_string("%03d", "running"), F.lit("."), "p_ext").alias("destination"))


def rename_plan(files: DataFrame, template: str) -> DataFrame:
    """(path, new_name) by a template of {name} {ext} {date} {time} {counter} {c}; dates count 365-day years and 30-day months.

    ``files``: path, filename, mtime_s. The counter follows the order of path. Names that are empty or hold a separator are null.
    """
    from heliograph.catalog import assign_ids

    counted = assign_ids(files, files.where(F.lit(False)).select(F.lit(0).cast("bigint").alias("n")), ["path"], "n")
    days, secs = F.floor(F.col("mtime_s") / 86400), F.pmod(F.col("mtime_s"), F.lit(86400))
    date = F.format_string("%04d%02d%02d", (1970 + F.floor(days / 365)).cast("int"), (F.floor(F.pmod(days, F.lit(365)) / 30) + 1).cast("int"), (F.pmod(F.pmod(days, F.lit(365)), F.lit(30)) + 1).cast("int"))
    time = F.format_string("%02d%02d%02d", F.floor(secs / 3600).cast("int"), F.floor(F.pmod(secs, F.lit(3600)) / 60).cast("int"), F.pmod(secs, F.lit(60)).cast("int"))
    values = {"{name}": X.stem(F.col("filename")), "{ext}": X.extension(F.col("path")), "{date}": date, "{time}": time, "{counter}": F.format_string("%03d", F.col("n").cast("bigint")), "{c}": F.col("n").cast("string")}
    name = F.lit(template)
    for key, value in values.items():
        name = F.replace(name, F.lit(key), value)
    return counted.select("path", F.when((name != "") & ~name.rlike(r"[/\\]"), name).alias("new_name"))


def rename_conflicts(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """(new_name, kind): names planned twice, and names that exist already (column filename)."""
    twice = plan.groupBy("new_name").agg(F.count("*").alias("n")).where("n > 1").select("new_name", F.lit("duplicate").alias("kind"))
    there = plan.select("new_name").distinct().join(existing.select(F.col("filename").alias("new_name")), "new_name", "left_semi").select("new_name", F.lit("exists").alias("kind"))
    return twice.unionByName(there)


def _gallery_orders() -> dict[str, list[Column]]:
    return {"name": [F.col("filename").asc_nulls_first(), F.col("id")], "date": [F.desc_nulls_last("modified_at"), F.col("id")], "size": [F.desc_nulls_last("size_bytes"), F.col("id")]}


def gallery(photos: DataFrame, by: str = "name") -> DataFrame:
    """Photos by name (by its bytes), newest first or largest first."""
    return photos.orderBy(*_gallery_orders()[by])


def gallery_ranks(photos: DataFrame) -> DataFrame:
    """(id, name_rank, date_rank, size_rank): the place of every photo, from 1, in each order of the gallery."""
    from heliograph.catalog import assign_ids

    ranked = photos.select("id", "filename", "modified_at", "size_bytes")
    for by, order in _gallery_orders().items():
        rank = f"{by}_rank"
        ranked = assign_ids(ranked, photos.where(F.lit(False)).select(F.lit(0).cast("bigint").alias(rank)), order, rank)
    return ranked.select("id", "name_rank", "date_rank", "size_rank")


def parse_reply(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with reply_description and reply_tags from JSON, from JSON in a code fence, or from a line that begins "tags:"."""
    schema = "description string, tags array<string>"
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    parsed = F.coalesce(*(F.when(F.from_json(c, schema)["description"].isNotNull(), F.from_json(c, schema)) for c in (F.trim(text), F.trim(fenced))))
    line = r"(?im)^[ \t]*\**[ \t]*tags:(.*)$"
    listed = F.transform(F.split(F.regexp_extract(text, line, 1), ","), lambda x: F.lower(F.trim(F.regexp_replace(F.trim(x), r"^\*+|\*+$", ""))))
    before = F.when(F.col(text).rlike(line), F.regexp_replace(text, r"(?ims)^[ \t]*\**[ \t]*tags:.*", "")).otherwise(F.col(text))
    before = F.regexp_replace(before, r"^\s+|\s+$", "")
    plain_tags = F.when(F.col(text).rlike(line), F.filter(listed, lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    return df.withColumns(
        {
            "reply_description": F.when(parsed.isNotNull(), parsed["description"]).otherwise(before),
            "reply_tags": F.when(parsed.isNotNull(), F.coalesce(parsed["tags"], F.array().cast("array<string>"))).otherwise(plain_tags),
        }
    )


def prompt(base: Column, context: Column) -> Column:
    return F.when(context.isNotNull() & (context != ""), F.concat(F.lit("Context: "), context, F.lit("\n\n"), base)).otherwise(base)
