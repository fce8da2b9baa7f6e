"""Point lookups, filters and projections on catalogue tables. Every result order is total, so limits are deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import exprs as X

RECORD = ["id", "path", "filename", "size_bytes", "width", "height", "taken_at", "sha256_hash", "perceptual_hash", "marked_for_deletion"]
EXPORT = ["path", "filename", "size_bytes", "width", "height", "camera_make", "camera_model", "taken_at", "description", "tags", "sha256_hash"]
METADATA = [
    "id", "path", "filename", "directory", "size_bytes", "width", "height", "format", "camera_make", "camera_model", "lens", "focal_length", "aperture", "shutter_speed", "iso", "taken_at",
    "gps_latitude", "gps_longitude", "all_exif", "description", "tags", "sha256_hash", "perceptual_hash", "modified_at",
]


#: Numbers that are no numbers are kept as null.
_REALS = ("focal_length", "aperture", "gps_latitude", "gps_longitude")


def value_of(df: DataFrame, key: str, wanted, column: str) -> DataFrame:
    """One column of the rows with a key, no row where there is none."""
    return df.where(F.col(key) == wanted).select(column)


def exists(df: DataFrame, key: str, wanted) -> DataFrame:
    """One row: whether any row has the key. Reads no more than one match."""
    return df.where(F.col(key) == wanted).select(F.lit(1).alias("x")).limit(1).agg((F.count("x") > 0).alias("found"))


def mtimes_in_directory(photos: DataFrame, directory: str) -> DataFrame:
    return photos.where(F.col("directory") == directory).select("path", "modified_at")


def metadata(photos: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """Photos with their face count and the sorted distinct names of the people in them; NaN counts as null."""
    named = faces.join(people.select(F.col("id").alias("person_id"), "name"), "person_id", "left")
    seen = named.groupBy(F.col("photo_id").alias("id")).agg(F.count("*").alias("face_count"), F.array_sort(F.collect_set("name")).alias("people"))
    own = photos.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in _REALS else F.col(c) for c in METADATA))
    return own.join(seen, "id", "left").withColumns({"face_count": F.coalesce("face_count", F.lit(0)), "people": F.coalesce("people", F.array().cast("array<string>"))})


def rotations(photos: DataFrame) -> DataFrame:
    return photos.select("path", X.rotation(F.col("exif_orientation"), F.col("user_rotation")).alias("rotation"))


def marked(photos: DataFrame, trashed_too: bool = True) -> DataFrame:
    rows = photos.where("marked_for_deletion")
    return (rows if trashed_too else rows.where("trashed_at IS NULL")).select(*RECORD).orderBy("path", "id")


def trashed(photos: DataFrame, before: str | None = None) -> DataFrame:
    """Photos in the trash, last one first; with ``before``, those whose text time sorts before it, first one first."""
    rows = photos.where("trashed_at IS NOT NULL").select("id", "path", "original_path", "size_bytes", "trashed_at")
    return rows.where(F.col("trashed_at") < before).orderBy("trashed_at", "id") if before else rows.orderBy(F.desc("trashed_at"), "id")


def trash_cutoff(now: Column, days: int) -> Column:
    """The text time, RFC 3339 in UTC, that lies ``days`` before the timestamp ``now``."""
    return F.date_format(now - F.expr(f"make_interval(0, 0, 0, {days})"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def undescribed(photos: DataFrame, directory: str | None = None, rule: str = "all", limit: int | None = None) -> DataFrame:
    """Photos without a description. rule: all; 'prefix' (path begins with the text, without a slash); 'exact' directory."""
    rows = photos.where("description IS NULL")
    if rule == "prefix":
        rows = rows.where(F.col("path").startswith(directory))
    elif rule == "exact":
        rows = rows.where(F.col("directory") == directory)
    order = {"all": [F.desc_nulls_last("scanned_at"), F.col("id")], "prefix": [F.col("path"), F.col("id")], "exact": [F.col("id")]}[rule]
    rows = rows.orderBy(*order)
    return (rows if limit is None else rows.limit(limit)).select("id", "path")


def with_empty_tags(photos: DataFrame) -> DataFrame:
    return photos.where("llm_processed_at IS NOT NULL AND (tags IS NULL OR tags IN ('[]', ''))").orderBy("llm_processed_at", "id").select("id", "path")


def first(df: DataFrame, condition: str, limit: int, order: list, columns: list[str]) -> DataFrame:
    """Top-k of a filtered table."""
    return df.where(condition).orderBy(*order).limit(limit).select(*columns)


def search_tags(tags: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return tags.where(F.lower("name").startswith(prefix.lower())).orderBy("name", "id").limit(limit).select("id", "name", "color")


def suggest_tags(tags: DataFrame, text: str) -> DataFrame:
    return tags.where(F.lower("name").contains(text.lower())).select("id", "name")


def pending(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'pending'").orderBy(F.asc_nulls_first("scheduled_at"), "id")


def overdue(tasks: DataFrame, now: str) -> DataFrame:
    return pending(tasks).where(F.col("scheduled_at") < now)


def due(tasks: DataFrame, now: str, limit: int | None = None) -> DataFrame:
    rows = pending(tasks).where(F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= now))
    return rows if limit is None else rows.orderBy(F.asc_nulls_first("scheduled_at"), "id").limit(limit)


def runnable(tasks: DataFrame, now: str, hour: int) -> DataFrame:
    """Due tasks whose hours of operation contain ``hour``."""
    return due(tasks, now).where(X.within_hours(F.lit(hour), F.col("hours_start"), F.col("hours_end")))


def export_rows(photos: DataFrame) -> DataFrame:
    return photos.select(*(X.basename(F.col("path")).alias("filename") if c == "filename" else F.col(c) for c in EXPORT)).orderBy("path")
