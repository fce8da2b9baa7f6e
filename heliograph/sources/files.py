"""Files on disk as rows: discovery, hashes, images and models behind small interfaces."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import exprs as X


def discover(spark: SparkSession, directory: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, modificationTime, length) of the images below a directory; extensions in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.where(X.extension(F.col("path")).isin(extensions or X.IMAGE_EXTENSIONS)).select(path.alias("path"), "modificationTime", "length")


def content_hashes(spark: SparkSession, directory: str, extensions: list[str] | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    chosen = files.where(X.extension(F.col("path")).isin(extensions or X.IMAGE_EXTENSIONS))
    return chosen.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.md5("content").alias("md5_hash"), F.sha2("content", 256).alias("sha256_hash"), F.col("length").alias("size_bytes"))


def list_directory(spark: SparkSession, directory: str, extensions: list[str] | None = None, hidden: bool = False, every: bool = False) -> DataFrame:
    """(name, path, is_dir, size) of one directory's entries: directories first, then by name in any case.

    Hidden entries and files that are no images are left out unless asked for. A folder that is not there has no entries.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    held = [(s.getPath().getName(), s.getPath().toUri().getPath(), s.isDirectory(), s.getLen()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    rows = spark.createDataFrame(held, "name string, path string, is_dir boolean, size bigint")
    rows = rows if hidden else rows.where(~F.col("name").startswith("."))
    rows = rows if every else rows.where(F.col("is_dir") | X.extension(F.col("path")).isin(extensions or X.IMAGE_EXTENSIONS))
    return rows.orderBy(F.desc("is_dir"), F.lower("name"), "name")


def trash_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, mtime_s, size) of the files right in a trash folder, without reading them; their total is one sum."""
    files = spark.read.format("binaryFile").load(directory)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.unix_seconds("modificationTime").alias("mtime_s"), F.col("length").alias("size"))


_FIELDS = {
    "width": "int", "height": "int", "camera_make": "string", "camera_model": "string", "lens": "string", "focal_length": "double", "aperture": "double", "shutter_speed": "string", "iso": "int",
    "taken_at": "string", "gps_latitude": "double", "gps_longitude": "double", "exif_orientation": "int", "all_exif": "string",
}


def scan(spark: SparkSession, directory: str, extensions: list[str] | None = None, perceptual=None) -> DataFrame:
    """One row a photo file, with the columns of ``photos`` that a scan fills, and ``error``.

    Size and time come from the listing, hashes and EXIF fields from the bytes. ``perceptual`` makes, once a task, a function
    from bytes to the text of a perceptual hash. A stage that fails leaves its columns null and its message in ``error``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    chosen = files.where(X.extension(F.col("path")).isin(extensions or X.IMAGE_EXTENSIONS))
    stated = chosen.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size_bytes"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_at"),
        F.md5("content").alias("md5_hash"), F.sha2("content", 256).alias("sha256_hash"), "content",
    )
    kept = [c for c in stated.columns if c != "content"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from heliograph.sources import exif

        hash_of = perceptual() if perceptual else None
        for batch in batches:
            rows = []
            for content in batch["content"]:
                row, errors = dict.fromkeys([*_FIELDS, "perceptual_hash"]), []
                for name, stage in (("exif", exif.read), ("perceptual hash", hash_of and (lambda b: {"perceptual_hash": hash_of(b)}))):
                    try:
                        row |= stage(bytes(content)) if stage else {}
                    except Exception as error:  # noqa: BLE001
                        errors.append(f"{name}: {error}")
                rows.append(row | {"error": "; ".join(errors) or None})
            yield pd.concat([batch[kept].reset_index(drop=True), pd.DataFrame(rows).astype(object)], axis=1)

    types = dict(stated.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), *(f"{n} {t}" for n, t in _FIELDS.items()), "perceptual_hash string", "error string"])
    found = stated.mapInPandas(read, schema)
    return found.withColumns({"filename": X.basename(F.col("path")), "directory": F.regexp_replace("path", "/[^/]*$", ""), "format": X.extension(F.col("path"))})


def thumbnails(files: DataFrame, shrink) -> DataFrame:
    """(key, path, rotation, thumbnail) of ``files`` (path, rotation, content); ``shrink`` makes, once a task, the function
    from bytes and degrees to a small image. A cache holds a thumbnail by its key and joins those that are there away first."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        make = shrink()
        for content, rotation in batches:
            yield pd.Series([make(bytes(b), int(r)) for b, r in zip(content, rotation, strict=True)])

    return files.select(F.xxhash64("path", "rotation").alias("key"), "path", "rotation", run("content", "rotation").alias("thumbnail"))


class Embedder(Protocol):
    """A model that turns the bytes of images into vectors; loaded once a worker."""

    def __call__(self, contents: pd.Series) -> pd.Series: ...


def embed(files: DataFrame, load) -> DataFrame:
    """``files`` (path, content) with ``embedding``; ``load`` makes the model, once a task, where it is needed."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return files.withColumn("embedding", run("content"))


def detect(files: DataFrame, load, least_confidence: float = 0.7) -> DataFrame:
    """(photo_id, bbox_x, bbox_y, bbox_w, bbox_h, confidence): one row a face that a detector finds, boxes clipped to the image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = [(i, *box) for i, content in zip(batch["photo_id"], batch["content"], strict=True) for box in model(content)]
            yield pd.DataFrame(rows, columns=["photo_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "confidence"])

    found = files.select("photo_id", "content").mapInPandas(run, "photo_id bigint, bbox_x int, bbox_y int, bbox_w int, bbox_h int, confidence double").where(F.col("confidence") > least_confidence)
    return found.withColumns({"bbox_x": F.greatest("bbox_x", F.lit(0)), "bbox_y": F.greatest("bbox_y", F.lit(0)), "bbox_w": F.greatest("bbox_w", F.lit(1)), "bbox_h": F.greatest("bbox_h", F.lit(1))})


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, parts: int = 16, bounds: tuple[int, int] = (0, 1 << 40), **options: str) -> DataFrame:
    """A table of a relational catalogue, read in ranges of its key; needs the driver's jar on the class path."""
    return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=options)
