"""Mixed timestamp formats and zones: one instant in UTC for each text, or none.

Missing zones are estimated per source. Evidence is gathered as (source, wall-clock hour): offsets that rows of the source
state, and the smallest offset that keeps a wall clock from lying after the row's ingestion. That table is bounded by
sources times hours, whatever the number of rows. A zone that a source declares stands unless its evidence contradicts it too
often. For the other sources the offset histories of the whole time zone database are tried: bounds by month and offset leave
few of them, whose violations are counted hour by hour. The history with the fewest is chosen, and of equal ones the one that
puts wall clocks closest to their ingestion; a history that too much evidence contradicts is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import instants as I
from heliograph.runtime import cut, cut_small, small, stage

#: Share of a source's evidence that may contradict a zone before it is given up.
MAX_CONTRADICTION = 0.5
HOUR_US = 3_600_000_000
#: Columns that ``resolve`` works with; a row's own columns of these names are set aside meanwhile.
_WORKING = {"_t", "_s", "_p", "_m", "_h", "_i", "_c", "_d", "epoch_us", "wall_us", "zone_text", "_zone", "_minutes", "_region", "_there", "_early", "_late", "_a", "_b"}


def resolve(df: DataFrame, text: str, default_zone: Column, out: str = "utc_us") -> DataFrame:
    """``df`` with the instant named by ``text`` in microseconds since 1970 UTC, as column ``out``.

    A stated zone counts first, then ``default_zone`` (an IANA name or an offset; null: none). Null, empty and unreadable
    texts, dates without a time of day, impossible dates, unknown zones, and wall clocks that a zone shows twice or never
    give null. Rows are neither dropped nor repeated; a column named ``out`` is replaced, all others are kept.
    """
    clashing = {name: f"__own_{name}" for name in df.columns if name in _WORKING}
    rows = df.withColumn("__default", default_zone).withColumnsRenamed(clashing)
    read = _instant(I.read_times(rows, clashing.get(text, text)), F.col("__default"), out)
    return read.drop("__default", *_WORKING - {out}).withColumnsRenamed({new: old for old, new in clashing.items() if old != out})


def _instant(read: DataFrame, default_zone: Column, out: str) -> DataFrame:
    """``read`` (with epoch_us, wall_us and zone_text) plus the instant they name; a stated zone comes before the default."""
    c = F.col
    read = stage(read, _zone=F.when(c("zone_text") == "", default_zone).otherwise(c("zone_text")))
    read = stage(read, _minutes=I.offset_minutes(c("_zone")))
    read = stage(read, _region=F.when(c("_minutes").isNull() & I.is_known_zone(read.sparkSession, "_zone"), c("_zone")))
    read = I.with_zone_instant(read, "wall_us", "_region", "_there")
    return stage(read, **{out: F.coalesce(c("epoch_us"), c("wall_us") - c("_minutes").cast("bigint") * 60_000_000, c("_there"))})


def with_source(rows: DataFrame, sources: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with the column ``root_dir`` of the longest source directory above ``path``; null where none is.

    An equi-join for each depth at which a source directory lies; only those few depths reach the driver.
    """
    depths = sorted((r[0] for r in sources.select(F.size(F.split("root_dir", "/")).alias("n")).where(F.col("root_dir").isNotNull()).distinct().collect()), reverse=True)
    out = rows
    for n in depths:
        key = sources.select(F.col("root_dir").alias(f"_root{n}")).where(F.size(F.split("root_dir", "/")) == n).distinct()
        out = out.withColumn("_key", F.substring_index(path, "/", n)).join(small(key), (F.col("_key") == F.col(f"_root{n}")) & (F.col(path) != F.col("_key")), "left").drop("_key")
    return out.withColumn("root_dir", F.coalesce(*(F.col(f"_root{n}") for n in depths), F.lit(None).cast("string"))).drop(*(f"_root{n}" for n in depths))


def _scored(hours: DataFrame, candidates: DataFrame) -> DataFrame:
    """(root_dir, candidate, violations, slack, weight) of each candidate (root_dir, candidate) on its source's hours."""
    c = F.col
    stated = c("offset_us").isNotNull()
    tried = stage(hours.join(small(candidates), "root_dir"), o=I.zone_offset_us(c("hour_us"), c("candidate")))
    wrong = F.when(stated, F.when(c("offset_us") != c("o"), c("n")).otherwise(0)).otherwise(F.when(c("floor_us") > c("o"), 1).otherwise(0))
    slack = F.when(~stated & (c("floor_us") <= c("o")), (c("o") - c("floor_us")) / HOUR_US).otherwise(0.0)
    return tried.groupBy("root_dir", "candidate").agg(F.sum(wrong).alias("violations"), F.round(F.sum(slack), 3).alias("slack"), F.sum(F.when(stated, c("n")).otherwise(1)).alias("weight"))


def _possible(hours: DataFrame, sources: DataFrame) -> DataFrame:
    """(root_dir, candidate): the zones of the database that may have the fewest violations for each of ``sources``.

    A stated offset that a zone has nowhere in its month is a violation. The zone with the fewest such ones is counted
    exactly, and no zone with more of them than that can be better. An equi-join by month and offset; its table holds the
    database's zones in the months that occur.
    """
    spark = hours.sparkSession
    own = hours.join(small(sources.select("root_dir")), "root_dir", "left_semi")
    month = F.trunc(F.timestamp_micros("hour_us").cast("date"), "month").alias("month")
    stated = cut_small(own.where("offset_us IS NOT NULL").groupBy("root_dir", month, "offset_us").agg(F.sum("n").alias("n")))
    zones = spark.createDataFrame([(z,) for z in I.known_zones(spark)], "candidate string")
    days = stated.select("month").distinct().select("month", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(34), F.lit(3)), lambda d: F.date_add("month", d))).alias("day"))
    at = days.withColumn("day_us", F.unix_date("day").cast("bigint") * 24 * HOUR_US).crossJoin(F.broadcast(zones))
    table = at.select("month", "candidate", I.zone_offset_us(F.col("day_us"), F.col("candidate")).alias("offset_us")).distinct()
    most = table.join(stated, ["month", "offset_us"]).groupBy("root_dir", "candidate").agg(F.sum("n").alias("most"))
    every = sources.select("root_dir").crossJoin(F.broadcast(zones)).join(most, ["root_dir", "candidate"], "left").select("root_dir", "candidate", F.coalesce("most", F.lit(0)).alias("most"))
    every = cut(every)  # sources times zones
    first = every.groupBy("root_dir").agg(F.max_by("candidate", F.struct("most", "candidate")).alias("candidate"))
    hit = _scored(own.where("offset_us IS NOT NULL"), first).select("root_dir", (F.col("weight") - F.col("violations")).alias("sure"))
    return every.join(hit, "root_dir", "left").where(F.col("most") >= F.coalesce("sure", F.lit(0))).select("root_dir", "candidate")


def estimate_zones(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(root_dir, time_zone, declared, estimated, violations, weight): the offset history chosen for each source.

    ``evidence``: root_dir, wall_us, offset_us (stated by the row, or null) and floor_us (the least offset that puts the
    wall clock at or before the row's ingestion, or null). ``sources``: root_dir, time_zone; a null time_zone declares none.
    A violation is a stated offset that a zone does not have at that hour, or an hour whose floor lies above its offset.
    A declared zone stands if at most ``MAX_CONTRADICTION`` of the weight violates it; of other sources the candidates are
    all zones of the database, ties go to the least distance from the floors, then to zones that other sources declare, then
    to the name; a zone that more of the weight violates is null. Sources without evidence keep their declared zone. violations and weight are those of the zone
    that was chosen, or of the best one if it was given up.
    """
    spark = evidence.sparkSession
    valid = sources.where(I.is_known_zone(spark, "time_zone"))
    hours = cut(
        evidence.where("root_dir IS NOT NULL AND wall_us IS NOT NULL AND (offset_us IS NOT NULL OR floor_us IS NOT NULL)")
        .groupBy("root_dir", (F.floor(F.col("wall_us") / HOUR_US) * HOUR_US).cast("bigint").alias("hour_us"), "offset_us")
        .agg(F.max("floor_us").alias("floor_us"), F.count("*").alias("n"))
    )
    declared = valid.groupBy("root_dir").agg(F.min("time_zone").alias("declared"))
    own = cut_small(_scored(hours, declared.select("root_dir", F.col("declared").alias("candidate"))))
    stands = own.where(F.col("violations") <= MAX_CONTRADICTION * F.col("weight"))
    open_ = cut_small(hours.select("root_dir").distinct().join(stands.select("root_dir"), "root_dir", "left_anti").join(sources.select("root_dir").distinct(), "root_dir", "left_semi"))
    best = stands
    if not open_.isEmpty():
        familiar = declared.select(F.col("declared").alias("candidate")).distinct().withColumn("_known", F.lit(0))
        tried = _scored(hours, _possible(hours, open_)).join(small(familiar), "candidate", "left").withColumn("_known", F.coalesce("_known", F.lit(1)))
        ranked = tried.groupBy("root_dir").agg(F.min_by(F.struct("candidate", "violations", "slack", "weight"), F.struct("violations", "slack", "_known", "candidate")).alias("b"))
        best = stands.unionByName(ranked.select("root_dir", "b.*"))
    chosen = F.when(F.col("weight").isNull(), F.col("declared")).when(F.col("violations") <= MAX_CONTRADICTION * F.col("weight"), F.col("candidate"))
    return (
        sources.select("root_dir").distinct().join(declared, "root_dir", "left").join(best, "root_dir", "left")
        .select("root_dir", chosen.alias("time_zone"), "declared", F.col("candidate").alias("estimated"), "violations", "weight")
    )


def exif_offset(column: str = "all_exif") -> Column:
    return F.get_json_object(F.col(column), "$['primary:OffsetTimeOriginal']")


#: Columns that ``_read`` adds.
_READ = ["__root", "__epoch", "__wall", "__stated", "__exif", "__modified_at", "__scanned_at"]


def _read(photos: DataFrame, sources: DataFrame) -> DataFrame:
    """``photos`` with what their texts say, read once for all that follows: the source, the instants of modified_at and
    scanned_at, and of taken_at the instant of a bare number, the wall clock and the zone as written, and the EXIF offset."""
    named = [c for c in ("root_dir",) if c in photos.columns]
    rows = with_source(photos.withColumnsRenamed({c: f"__own_{c}" for c in named}), sources).withColumnRenamed("root_dir", "__root").withColumnsRenamed({f"__own_{c}": c for c in named})
    for name in ("modified_at", "scanned_at"):
        rows = resolve(rows, name, F.lit("UTC"), f"__{name}")
    rows = rows.withColumn("__exif", exif_offset()).withColumn("__exif", F.when(I.offset_minutes(F.col("__exif")).isNotNull(), F.col("__exif")))
    clashing = {name: f"__own_{name}" for name in photos.columns if name in _WORKING}
    read = I.read_times(rows.withColumnsRenamed(clashing), "taken_at").withColumnsRenamed({"epoch_us": "__epoch", "wall_us": "__wall", "zone_text": "__stated"})
    return cut(read.withColumnsRenamed({new: old for old, new in clashing.items()}).select(*photos.columns, *_READ))


def _zones(read: DataFrame, sources: DataFrame) -> DataFrame:
    stated = F.when(F.col("__stated") == "", I.offset_minutes(F.col("__exif")))
    floor = F.col("__wall") - F.least("__modified_at", "__scanned_at")
    evidence = read.select(
        F.col("__root").alias("root_dir"), F.col("__wall").alias("wall_us"), (stated.cast("bigint") * 60_000_000).alias("offset_us"), F.when((F.col("__stated") == "") & stated.isNull(), floor).alias("floor_us")
    )
    return estimate_zones(evidence, sources)


def _taken(read: DataFrame, sources: DataFrame, out: str) -> DataFrame:
    """``read`` plus the instant of taken_at."""
    zones = cut_small(_zones(read, sources).select(F.col("root_dir").alias("__root"), F.col("time_zone").alias("__zone")))
    clashing = {name: f"__own_{name}" for name in read.columns if name in _WORKING}
    rows = read.withColumnsRenamed(clashing).join(zones, "__root", "left").withColumns({"epoch_us": F.col("__epoch"), "wall_us": F.col("__wall"), "zone_text": F.col("__stated")})
    found = _instant(rows, F.coalesce("__exif", "__zone"), "__out").drop(*_WORKING).withColumnsRenamed({new: old for old, new in clashing.items()})
    return found.drop(out, "__zone").withColumnRenamed("__out", out)


def source_zones(photos: DataFrame, sources: DataFrame) -> DataFrame:
    """The zone of each source directory of a photo catalogue, by ``estimate_zones`` over all its rows."""
    return _zones(_read(photos.select("path", "taken_at", "modified_at", "scanned_at", "all_exif"), sources), sources)


def taken_instants(photos: DataFrame, sources: DataFrame, out: str = "taken_us", source: str | None = None) -> DataFrame:
    """``photos`` (with path, taken_at, modified_at, scanned_at, all_exif) plus the instant of taken_at.

    A usable EXIF offset comes before the source's zone. ``source`` names a further column for the source directory. All
    other columns are kept; those named ``out`` or ``source`` are replaced.
    """
    found = _taken(_read(photos, sources), sources, out)
    if source:
        found = found.drop(source).withColumn(source, F.col("__root"))
    return found.drop(*_READ)


def normalise(photos: DataFrame, sources: DataFrame) -> DataFrame:
    """(photo_id, field_name, text, utc_us) for the three written times of each photo; utc_us is null where none is named."""
    read = _taken(_read(photos.select("id", "path", "taken_at", "modified_at", "scanned_at", "all_exif"), sources), sources, "__taken_at")
    times = F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).alias("text"), F.col(f"__{n}").alias("utc_us")) for n in ("taken_at", "modified_at", "scanned_at")))
    return read.select(F.col("id").alias("photo_id"), F.inline(times))
