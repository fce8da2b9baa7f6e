"""Batches that call models and services, and the loop that runs due tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions import exprs as X
from heliograph.operators import lookups, mutations
from heliograph.runtime import cut

#: Failures in a row after which a worker takes a service for unavailable.
MAX_FAILURES = 3


@dataclass
class Settings:
    """Settings with the catalogue's defaults; ``of`` takes the known ones of a mapping, such as a parsed TOML file."""

    similarity_threshold: int = 50
    trash_days: int = 30
    trash_bytes: int = 1 << 30
    concurrency: int = 4
    longest_filename: int = 100
    image_extensions: list[str] = field(default_factory=lambda: list(X.IMAGE_EXTENSIONS))

    @classmethod
    def of(cls, values: dict) -> Settings:
        return cls(**{k: v for k, v in values.items() if k in cls.__dataclass_fields__})


def describe(photos: DataFrame, load: Callable, workers: int = Settings.concurrency, most_failures: int = MAX_FAILURES) -> DataFrame:
    """(id, description, tags, error) of ``photos`` (id, path, prompt), by a service that ``load`` opens once a worker.

    The service takes a path and a prompt and gives (description, list of tags). After ``most_failures`` failures in a row a
    worker calls it no more; its remaining photos get the error 'unavailable' and stay to be done. Results are written
    once, since a second run would call the service again. ``workers`` bounds the calls at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, failures = load(), 0
        for batch in batches:
            rows = []
            for i, path, prompt in zip(batch["id"], batch["path"], batch["prompt"], strict=True):
                if failures >= most_failures:
                    rows.append((i, None, None, "unavailable"))
                    continue
                try:
                    text, tags = service(path, prompt)
                    rows.append((i, text, list(tags), None))
                    failures = 0
                except Exception as error:  # noqa: BLE001
                    failures += 1
                    rows.append((i, None, None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=["id", "description", "tags", "error"])

    return cut(photos.select("id", "path", "prompt").repartition(workers).mapInPandas(run, "id bigint, description string, tags array<string>, error string"))


def save_descriptions(photos: DataFrame, described: DataFrame, now: str) -> DataFrame:
    """``photos`` with the results of ``describe``; those with an error stay as they are."""
    good = described.where("error IS NULL").select("id", "description", F.to_json("tags").alias("tags"), F.lit(now).alias("llm_processed_at"))
    return mutations.update_from(photos, good, "id")


def find_faces(photos: DataFrame, load: Callable, now: str) -> tuple[DataFrame, DataFrame]:
    """(faces, face_scans) of ``photos`` (id, content): one row a face, and one a photo that was looked at.

    ``load`` opens, once a worker, a detector from bytes to (x, y, w, h, confidence, vector or null). A photo without a face
    counts as scanned, one that failed does not.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = load()
        for batch in batches:
            rows = []
            for i, content in zip(batch["id"], batch["content"], strict=True):
                try:
                    found = list(detector(bytes(content)))
                    rows += [(i, True, *face) for face in found] or [(i, True, *[None] * 6)]
                except Exception:  # noqa: BLE001
                    rows.append((i, False, *[None] * 6))
            yield pd.DataFrame(rows, columns=["photo_id", "scanned", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "confidence", "embedding"]).astype({"bbox_x": "Int32", "bbox_y": "Int32", "bbox_w": "Int32", "bbox_h": "Int32"})

    every = cut(photos.select("id", "content").mapInPandas(run, "photo_id bigint, scanned boolean, bbox_x int, bbox_y int, bbox_w int, bbox_h int, confidence double, embedding array<float>"))
    faces = every.where("bbox_x IS NOT NULL").drop("scanned").withColumns({"embedding_dim": F.when(F.col("embedding").isNotNull(), F.size("embedding")), "created_at": F.lit(now)})
    return faces, every.where("scanned").groupBy("photo_id").agg(F.lit(now).alias("scanned_at"), F.count("bbox_x").cast("int").alias("faces_found"))


def expire_trash(photos: DataFrame, now: str, days: int = Settings.trash_days) -> tuple[DataFrame, DataFrame]:
    """(photos that stay, photos whose files are to be deleted): trashed longer ago than ``days``."""
    old = lookups.trashed(photos, photos.sparkSession.range(1).select(lookups.trash_cutoff(F.lit(now).cast("timestamp"), days)).first()[0])
    return photos.join(old.select("id"), "id", "left_anti"), old


def run_due(tasks: DataFrame, work: dict[str, Callable[[dict], None]], now: datetime) -> DataFrame:
    """``tasks`` after one turn of the loop: each that is due and within its hours runs, oldest first, and is marked.

    ``work`` has a function for each task_type, which gets the task's row. One that raises is failed with its message, one
    of an unknown type too. Due tasks are few: they reach the driver, which starts their jobs.
    """
    text = now.strftime("%Y-%m-%dT%H:%M:%S")
    for row in lookups.runnable(tasks, text, now.hour).collect():
        status, error = "completed", None
        try:
            work[row["task_type"]](row.asDict())
        except KeyError:
            status, error = "failed", f"unknown task type {row['task_type']}"
        except Exception as problem:  # noqa: BLE001
            status, error = "failed", str(problem)
        tasks = mutations.set_status(mutations.set_status(tasks, row["id"], "running", text), row["id"], status, text, error)
    return tasks
