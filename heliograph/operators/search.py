"""Vector and keyword top-k search, and the cascade over both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions import exprs as X


def by_vector(vectors: DataFrame, query: list[float], k: int, least: float, id_column: str = "photo_id", vector: str = "embedding") -> DataFrame:
    """(id, similarity) of the k most similar vectors at or above ``least``; one scan and a top-k, no shuffle of vectors.

    Vectors that give no number, as those with NaN, are no hits.
    """
    q = F.lit(query).cast("array<double>")
    scored = vectors.select(F.col(id_column), F.round(X.cosine(F.col(vector), q), 6).alias("similarity"))
    return scored.where((F.col("similarity") >= least) & ~F.isnan("similarity")).orderBy(F.desc("similarity"), id_column).limit(k)


def with_photos(hits: DataFrame, photos: DataFrame) -> DataFrame:
    """Hits with their photos, looked up after the limit: hits without a photo shrink the result."""
    return hits.join(photos.select(F.col("id").alias("photo_id"), "path", "filename"), "photo_id")


def by_words(rows: DataFrame, query: str, k: int, text: str = "description", id_column: str = "id") -> DataFrame:
    """(id, similarity): the share of the query's words (repeats count) that occur anywhere in the text, the k best above 0."""
    words = query.lower().split()
    if not words:
        return rows.where(F.lit(False)).select(id_column, F.lit(0.0).alias("similarity"))
    low = F.lower(text)
    hits = sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    scored = rows.where(F.col(text).isNotNull()).select(id_column, (hits / len(words)).alias("similarity"))
    return scored.where("similarity > 0").orderBy(F.desc("similarity"), id_column).limit(k)


def cascade(vectors: DataFrame, photos: DataFrame, query: str, embed=None, describe=None, k: int = 20) -> DataFrame:
    """The first of three searches that finds anything: image-model vector, provider vector, words."""
    for model, least in ((embed, 0.2), (describe, 0.3)):
        if model is not None and not vectors.isEmpty():
            hits = with_photos(by_vector(vectors, model(query), k, least), photos)
            if not hits.isEmpty():
                return hits
    return with_photos(by_words(photos, query, k).withColumnRenamed("id", "photo_id"), photos)
