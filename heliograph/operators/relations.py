"""Joins and aggregations on catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import exprs as X

FACE = ["id", "photo_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "person_id", "confidence"]


def faces_with_photos(faces: DataFrame, photos: DataFrame, condition: Column) -> DataFrame:
    seen = photos.select(F.col("id").alias("photo_id"), "path", "filename", "taken_at")
    return faces.where(condition).select(*FACE).join(seen, "photo_id").select(*FACE, "path", "filename", "taken_at").orderBy(F.desc_nulls_last("taken_at"), "id")


def photos_of_person(photos: DataFrame, faces: DataFrame, person: int) -> DataFrame:
    """A semi-join: as the join's distinct rows, but without producing the repeats."""
    own = faces.where(F.col("person_id") == person).select(F.col("photo_id").alias("id"))
    return photos.join(own, "id", "left_semi").orderBy(F.desc_nulls_last("taken_at"), "id").select("id", "path", "filename")


def without(photos: DataFrame, other: DataFrame, key: str = "photo_id", directory: str | None = None, exact: bool = False) -> DataFrame:
    """Photos without a row in ``other``, in a directory (below it, or exactly it) or everywhere."""
    rows = photos
    if directory is not None:
        rows = rows.where(F.col("directory") == directory) if exact else rows.where(X.under(F.col("path"), directory))
    return rows.join(other.select(F.col(key).alias("id")), "id", "left_anti").select("id", "path")


def tags_of_photo(tags: DataFrame, bridge: DataFrame, photo: int) -> DataFrame:
    own = bridge.where(F.col("photo_id") == photo).select(F.col("tag_id").alias("id"))
    return tags.join(own, "id").select("id", "name", "color")


def album_paths(photos: DataFrame, bridge: DataFrame, album: int) -> DataFrame:
    own = bridge.where(F.col("album_id") == album).select(F.col("photo_id").alias("id"), "position", "added_at")
    return photos.select("id", "path").join(own, "id").select("path", "position", "added_at").orderBy("position", "added_at", "path")


def people_with_counts(people: DataFrame, faces: DataFrame, person: int | None = None, name: str | None = None) -> DataFrame:
    """People with their number of faces, 0 included; a filter on one person reaches both scans."""
    rows, found = people, faces.where("person_id IS NOT NULL")
    if person is not None:
        rows, found = rows.where(F.col("id") == person), found.where(F.col("person_id") == person)
    if name is not None:
        rows = rows.where(F.lower("name") == name.lower())
    counts = found.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("face_count"))
    return rows.select("id", "name").join(counts, "id", "left").withColumn("face_count", F.coalesce("face_count", F.lit(0))).orderBy("name", "id")


def with_member_counts(groups: DataFrame, members: DataFrame, key: str, columns: list[str], out: str) -> DataFrame:
    counts = members.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(out))
    return groups.select(*columns).join(counts, "id", "left").withColumn(out, F.coalesce(out, F.lit(0))).orderBy(F.desc(out), "id")


def count(df: DataFrame, condition: str | Column | None = None, out: str = "n") -> DataFrame:
    return (df if condition is None else df.where(condition)).agg(F.count("*").alias(out))


def trash_size(photos: DataFrame) -> DataFrame:
    return photos.where("trashed_at IS NOT NULL").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total"))


def smart_album(bridge: DataFrame, filter_tags: list[int]) -> DataFrame:
    """Photos that have every tag of a list. As the list's length counts, a list with repeats matches nothing; [] neither."""
    if not filter_tags:
        return bridge.where(F.lit(False)).select("photo_id")
    held = bridge.where(F.col("tag_id").isin(filter_tags)).groupBy("photo_id").agg(F.countDistinct("tag_id").alias("n"))
    return held.where(F.col("n") == len(filter_tags)).select("photo_id")


def smart_albums(albums: DataFrame, bridge: DataFrame) -> DataFrame:
    """(album_id, photo_id) of all smart albums at once: relational division by each album's own list."""
    wanted = albums.where("is_smart").select(F.col("id").alias("album_id"), X.long_array(F.col("filter_tags")).alias("tags"))
    wanted = wanted.withColumn("n", F.size("tags")).select("album_id", "n", F.explode("tags").alias("tag_id")).distinct()
    held = bridge.select("photo_id", "tag_id").distinct().join(wanted, "tag_id")
    return held.groupBy("album_id", "photo_id", "n").agg(F.count("*").alias("c")).where("c = n").select("album_id", "photo_id")


def by_camera(photos: DataFrame) -> DataFrame:
    return photos.where("camera_model IS NOT NULL").groupBy("camera_make", "camera_model").agg(F.count("*").alias("n"))


def largest_directories(photos: DataFrame, limit: int = 10) -> DataFrame:
    totals = photos.groupBy("directory").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    return totals.orderBy(F.desc_nulls_last("bytes"), "directory").limit(limit)
