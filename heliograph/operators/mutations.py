"""Changes of catalogue tables, as steps from one DataFrame to the next. ``Catalog.commit`` writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliograph.catalog import assign_ids
from heliograph.functions import exprs as X


def update(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """UPDATE: columns change on the rows that meet the condition, in one projection without a shuffle."""
    hit = F.coalesce(condition, F.lit(False))
    return df.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in df.columns))


def update_from(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """UPDATE ... FROM: rows with a partner in ``changes`` (unique key) take its other columns."""
    named = changes.select(F.col(key), *(F.col(c).alias(f"_n_{c}") for c in changes.columns if c != key), F.lit(True).alias("_hit"))
    joined = df.join(named, key, "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in df.columns))


def delete(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_ids(df: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    return df if not ids else df.where(~F.col(key).isin(ids))


def insert_ignore(df: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR IGNORE: rows of ``fresh`` whose key is new; of several with one key, any."""
    return df.unionByName(fresh.dropDuplicates(keys).join(df.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def insert_new(df: DataFrame, fresh: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As ``insert_ignore``, with ids assigned above the largest."""
    new = fresh.dropDuplicates(keys).join(df.select(*keys), keys, "left_anti")
    return df.unionByName(assign_ids(new, df, order), allowMissingColumns=True)


def upsert(df: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR REPLACE: rows of ``fresh`` replace those of the same key."""
    return df.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    newest = W.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


# photos
def save_description(photos: DataFrame, path: str, text: str, now: str) -> DataFrame:
    return update(photos, F.col("path") == path, {"description": F.lit(text), "llm_processed_at": F.lit(now)})


def save_result(photos: DataFrame, photo: int, text: str, tags_json: str, now: str) -> DataFrame:
    return update(photos, F.col("id") == photo, {"description": F.lit(text), "tags": F.lit(tags_json), "llm_processed_at": F.lit(now)})


def clear_result(photos: DataFrame, photo: int) -> DataFrame:
    return update(photos, F.col("id") == photo, dict.fromkeys(("description", "tags", "llm_processed_at"), F.lit(None)))


def move_path(photos: DataFrame, old: str, new: str) -> DataFrame:
    """Only the path changes; filename and directory stay as they were."""
    return update(photos, F.col("path") == old, {"path": F.lit(new)})


def set_rotation(photos: DataFrame, path: str, degrees: int) -> DataFrame:
    return update(photos, F.col("path") == path, {"user_rotation": F.pmod(F.lit(degrees), F.lit(360))})


def rotate(photos: DataFrame, path: str, by: int) -> DataFrame:
    return update(photos, F.col("path") == path, {"user_rotation": F.pmod(F.coalesce("user_rotation", F.lit(0)) + by, F.lit(360))})


def mark(photos: DataFrame, ids: list[int], value: bool = True) -> DataFrame:
    return update(photos, F.col("id").isin(ids), {"marked_for_deletion": F.lit(value)})


def move_to_trash(photos: DataFrame, photo: int, trash_path: str, now: str) -> DataFrame:
    return update(photos, F.col("id") == photo, {"original_path": F.col("path"), "path": F.lit(trash_path), "trashed_at": F.lit(now), "marked_for_deletion": F.lit(False)})


def restore(photos: DataFrame, photo: int) -> DataFrame:
    back = (F.col("id") == photo) & F.col("original_path").isNotNull()
    return update(photos, back, {"path": F.col("original_path"), "original_path": F.lit(None), "trashed_at": F.lit(None)})


# people and faces
def find_or_create(people: DataFrame, names: DataFrame, now: str) -> DataFrame:
    """People with a row for every name that no person has yet, whatever its case."""
    fresh = names.select("name", F.lower("name").alias("_low")).groupBy("_low").agg(F.min("name").alias("name"))
    new = fresh.join(people.select(F.lower("name").alias("_low")), "_low", "left_anti").select("name", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return people.unionByName(assign_ids(new, people, ["name"]), allowMissingColumns=True)


def assign_faces(faces: DataFrame, ids: list[int], person: int | None) -> DataFrame:
    return update(faces, F.col("id").isin(ids), {"person_id": F.lit(person)})


def cluster_to_person(faces: DataFrame, members: DataFrame, cluster: int, person: int) -> DataFrame:
    own = members.where(F.col("cluster_id") == cluster).select(F.col("face_id").alias("id")).distinct().withColumn("person_id", F.lit(person).cast("bigint"))
    return update_from(faces, own, "id")


def merge_clusters(faces: DataFrame, members: DataFrame, clusters: list[int], person: int) -> DataFrame:
    """The unassigned faces of the listed clusters get one person; faces outside them are left alone."""
    own = members.where(F.col("cluster_id").isin(clusters)).select(F.col("face_id").alias("id")).distinct().withColumn("_own", F.lit(True))
    joined = faces.join(own, "id", "left")
    return joined.withColumn("person_id", F.when(F.col("_own") & F.col("person_id").isNull(), F.lit(person)).otherwise(F.col("person_id"))).select(*faces.columns)


# tasks, tags, albums, prompts
def set_status(tasks: DataFrame, task: int, status: str, now: str, error: str | None = None) -> DataFrame:
    changes = {"status": F.lit(status)}
    if status == "running":
        changes["started_at"] = F.lit(now)
    elif status in ("completed", "failed", "cancelled"):
        changes |= {"completed_at": F.lit(now), "error_message": F.lit(error)}
    return update(tasks, F.col("id") == task, changes)


def set_filter_tags(albums: DataFrame, album: int, tags: list[int]) -> DataFrame:
    return update(albums, F.col("id") == album, {"filter_tags": F.to_json(F.array(*(F.lit(t) for t in tags))) if tags else F.lit("[]"), "is_smart": F.lit(True)})


def set_prompt(prompts: DataFrame, directory: str, text: str, now: str) -> DataFrame:
    """An empty prompt deletes the directory's row."""
    rest = prompts.where(F.col("directory") != directory)
    return rest if not text else rest.unionByName(prompts.sparkSession.createDataFrame([(directory, text, now)], "directory string, custom_prompt string, updated_at string"), allowMissingColumns=True)


def rename(df: DataFrame, row: int, name: str) -> DataFrame:
    return update(df, F.col("id") == row, {"name": F.lit(name)})


def basic_photos(paths: DataFrame, now: str) -> DataFrame:
    """Stub rows (path, size_bytes) for files without metadata."""
    return paths.select(
        "path", X.basename(F.col("path")).alias("filename"), F.regexp_replace("path", "/[^/]*$", "").alias("directory"), F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"), F.lit(now).alias("scanned_at")
    )
