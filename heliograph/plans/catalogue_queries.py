"""Queries pN_ of the core operators on catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import spatial, timestamps
from heliograph.runtime import table

#: Usual forms, which name an instant without any work and are not asked for.
_USUAL = {"modified_at": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "scanned_at": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"}


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    found = timestamps.normalise(table(spark, root, "photos"), table(spark, root, "library_roots"))
    usual = F.lit(False)
    for name, pattern in _USUAL.items():
        usual = usual | ((F.col("field_name") == name) & F.col("text").rlike(pattern))
    return found.where(F.col("utc_us").isNotNull() & ~usual).select("photo_id", "field_name", "utc_us").distinct()


def p1_zones(spark: SparkSession, root: str) -> DataFrame:
    return timestamps.source_zones(table(spark, root, "photos"), table(spark, root, "library_roots"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    points = _points(spark, root)
    regions = table(spark, root, "places").withColumnRenamed("place_id", "region_id")
    found = spatial.points_in_regions(points, regions)
    return found.select(F.col("point_id").alias("photo_id"), F.col("region_id").alias("place_id"))


#: Metres within which photos count as taken at one spot.
NEAR_M = 25.0


def _points(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "photos").select(F.col("id").alias("point_id"), F.col("gps_latitude").alias("latitude"), F.col("gps_longitude").alias("longitude"))


def p6_near(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of different positions of photos within 25 m; a position goes by its smallest photo id, see p6_positions."""
    return spatial.near_pairs(spatial.positions(_points(spark, root))[0], NEAR_M).select("id_a", "id_b", F.round("metres", 3).alias("metres"))


def p6_positions(spark: SparkSession, root: str) -> DataFrame:
    """The position of each photo that has a usable one."""
    return spatial.positions(_points(spark, root))[1]


QUERIES = {"p1_found": p1_found, "p1_zones": p1_zones, "p6_found": p6_found, "p6_near": p6_near, "p6_positions": p6_positions}

_POSITION = "(SELECT id, gps_latitude AS la, CASE WHEN gps_longitude >= -180 AND gps_longitude < 180 THEN gps_longitude ELSE ((gps_longitude + 180) % 360 + 360) % 360 - 180 END AS lo FROM photos WHERE isfinite(gps_latitude) AND isfinite(gps_longitude) AND NOT (gps_latitude = 0 AND gps_longitude = 0) AND abs(gps_latitude) <= 90 AND abs(gps_longitude) <= 360)"
ORACLE_SQL = {
    "p6_found": f"""WITH u AS MATERIALIZED {_POSITION},
 e AS MATERIALIZED (SELECT place_id, ring_lat[k] AS y1, ring_lon[k] AS x1, ring_lat[CASE k WHEN 1 THEN len(ring_lat) ELSE k - 1 END] AS y2, ring_lon[CASE k WHEN 1 THEN len(ring_lat) ELSE k - 1 END] AS x2 FROM (SELECT *, unnest(range(1, len(ring_lat) + 1)) AS k FROM places WHERE shape = 'polygon')),
 p AS (SELECT u.id, e.place_id, t.turn, count(*) AS crossings FROM u, e, (VALUES (-360), (0), (360)) t(turn) WHERE (y1 > la) <> (y2 > la) AND lo + turn < x1 + (la - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL)
 SELECT id AS photo_id, place_id FROM u, places WHERE shape = 'circle' AND 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(la - latitude) / 2), 2) + cos(radians(la)) * cos(radians(latitude)) * pow(sin(radians(lo - longitude) / 2), 2)))) <= radius_m
 UNION SELECT id, place_id FROM p WHERE crossings % 2 = 1""",
    "p6_near": f"""WITH p AS MATERIALIZED (SELECT min(id) AS id, la, lo FROM {_POSITION} GROUP BY la, lo),
 d AS (SELECT a.id AS a, b.id AS b, 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(a.la - b.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(a.lo - b.lo) / 2), 2)))) AS m FROM p a JOIN p b ON a.id < b.id AND abs(a.la - b.la) < 0.001)
 SELECT a AS id_a, b AS id_b, round(m, 3) AS metres FROM d WHERE m <= {NEAR_M}""",
    "p6_positions": f"SELECT id AS point_id, min(id) OVER (PARTITION BY la, lo) AS position_id FROM {_POSITION}",
}
