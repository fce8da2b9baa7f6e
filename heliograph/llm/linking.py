"""Links between catalogue photos, as edges for the component operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.hashes import perceptual_bits

#: Least score of a member for it to be linked with others of its group; scores above 1 are percentages.
LINK_SCORE = 0.8


def star(members: DataFrame, key: str, member: str) -> DataFrame:
    """Edges (a, b) that join all members of a key to its smallest one: as many as members, not as many as pairs."""
    centres = members.groupBy(key).agg(F.min(member).alias("a"), F.max(member).alias("top")).where("a < top").select(key, "a")
    return members.join(centres, key).select("a", F.col(member).alias("b")).where("a < b").distinct()


def photo_links(similarity: DataFrame, photos: DataFrame, least: float = LINK_SCORE) -> DataFrame:
    """Edges of photos that share a group with sufficient scores each, or whose perceptual hashes stand for the same bits.

    Null or not finite scores and unreadable or all-zero hashes link nothing; repeated rows link once.
    """
    score = F.col("similarity_score")
    score = F.when(score > 1, score / 100).otherwise(score)
    strong = similarity.where((score >= least) & ~F.isnan("similarity_score") & F.col("group_id").isNotNull() & F.col("photo_id").isNotNull()).select("group_id", "photo_id").distinct()
    hashed = photos.select(F.col("id").alias("photo_id"), perceptual_bits(F.col("perceptual_hash")).alias("bits")).where("bits IS NOT NULL")
    return star(strong, "group_id", "photo_id").unionByName(star(hashed, "bits", "photo_id"))
