"""Points in regions and points near points, by overlapping latitude strips and a sweep along longitude.

Latitude is cut into strips. A point lies in exactly one strip, which owns all its pairs; a region is copied to every strip
that it touches, so no pair is lost or found twice. Within a strip both sides are sorted by longitude and swept: a region
is active while the sweep is between its western and eastern ends, and only active regions are verified. Strips with many
points or regions are dealt into parts of both, and each pair of parts is one task.

For points near points a strip is at least as high as the distance. Each point lies in its own strip, which owns its pairs
with the points south of it, and is copied to the strip below for the pairs of points there; the sweep keeps the points
within the distance east of each one active. Points at one position are one point with several ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.geo import EARTH_RADIUS_M, usable_position, wrap_longitude
from heliograph.runtime import cut, cut_small

STRIP_DEGREES = 1.0
#: Points swept together at most, about; a strip with more is salted.
POINTS_PER_TASK = 200_000
#: Regions swept together at most, about.
REGIONS_PER_TASK = 5_000
#: Points of either side that are compared in one task of ``near_pairs`` at most, about.
NEAR_PER_TASK = 50_000
_REGION = "strip int, region_id bigint, shape string, latitude double, longitude double, radius_m double, ring_lat array<double>, ring_lon array<double>, south double, north double, west double, east double"


def regions_with_bounds(regions: DataFrame) -> DataFrame:
    """``regions`` (region_id, shape, latitude, longitude, radius_m, ring_lat, ring_lon) with a box each, in strips.

    Regions that cannot contain a point (null or not finite centre or radius, rings of fewer than three corners or with
    nulls, other shapes) are left out. Boxes may run past 180 degrees either way; a circle around a pole spans all longitudes.
    """
    reach = F.degrees(F.col("radius_m") / EARTH_RADIUS_M)
    circle = (F.col("shape") == "circle") & (F.col("radius_m") >= 0) & (F.abs("latitude") <= 90) & (F.abs("longitude") <= 360)
    ring = (F.col("shape") == "polygon") & (F.size("ring_lat") >= 3) & (F.size("ring_lat") == F.size("ring_lon")) & ~F.exists("ring_lat", lambda x: x.isNull() | F.isnan(x)) & ~F.exists("ring_lon", lambda x: x.isNull() | F.isnan(x))
    pad = 1e-7
    whole = (F.abs("latitude") + reach >= 89.9) | (reach >= 89.9)
    half = F.when(whole, 360.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(F.col("latitude"))))))) + pad
    known = regions.select("region_id", "shape", "latitude", "longitude", "radius_m", "ring_lat", "ring_lon")
    boxed = known.where(F.coalesce(circle | ring, F.lit(False))).withColumns(
        {
            "south": F.when(F.col("shape") == "circle", F.col("latitude") - reach).otherwise(F.array_min("ring_lat")) - pad,
            "north": F.when(F.col("shape") == "circle", F.col("latitude") + reach).otherwise(F.array_max("ring_lat")) + pad,
            "west": F.when(F.col("shape") == "circle", F.col("longitude") - half).otherwise(F.array_min("ring_lon")) - pad,
            "east": F.when(F.col("shape") == "circle", F.col("longitude") + half).otherwise(F.array_max("ring_lon")) + pad,
        }
    )
    strip = lambda c: F.floor(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), c)) / STRIP_DEGREES).cast("int")
    return boxed.withColumn("strip", F.explode(F.sequence(strip(F.col("south")), strip(F.col("north")))))


def _inside(lat: np.ndarray, lon: np.ndarray, region: dict) -> np.ndarray:
    if region["shape"] == "circle":
        a, b = np.radians(lat), math.radians(region["latitude"])
        h = np.sin((a - b) / 2) ** 2 + np.cos(a) * math.cos(b) * np.sin(np.radians(lon - region["longitude"]) / 2) ** 2
        return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h))) <= region["radius_m"]
    odd = np.zeros(len(lat), bool)
    ys, xs = np.asarray(region["ring_lat"]), np.asarray(region["ring_lon"])
    for k in range(len(ys)):
        y1, x1, y2, x2 = ys[k], xs[k], ys[k - 1], xs[k - 1]
        crosses = (y1 > lat) != (y2 > lat)
        if crosses.any():
            odd[crosses] ^= lon[crosses] < x1 + (lat[crosses] - y1) * (x2 - x1) / (y2 - y1)
    return odd


def _sweep(points: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one strip. Each region enters the sweep up to three times, a turn west, as it is, and a turn east."""
    found_p, found_r = [], []
    if len(points) and len(regions):
        points = points.sort_values("lon", kind="stable")
        lon, lat, ids = points["lon"].to_numpy(), points["lat"].to_numpy(), points["point_id"].to_numpy()
        spans = []
        for region in regions.to_dict("records"):
            for turn in (-360.0, 0.0, 360.0):
                first, last = np.searchsorted(lon, region["west"] + turn, "left"), np.searchsorted(lon, region["east"] + turn, "right")
                if first < last:
                    spans.append((first, last, turn, region))
        for first, last, turn, region in sorted(spans, key=lambda s: s[0]):
            hit = _inside(lat[first:last], lon[first:last] - turn, region)
            found_p.append(ids[first:last][hit])
            found_r.append(np.full(int(hit.sum()), region["region_id"], np.int64))
    none = np.empty(0, np.int64)
    return pd.DataFrame({"point_id": np.concatenate([none, *found_p]), "region_id": np.concatenate([none, *found_r])})


def points_in_regions(points: DataFrame, regions: DataFrame, points_per_task: int = POINTS_PER_TASK, regions_per_task: int = REGIONS_PER_TASK) -> DataFrame:
    """Distinct (point_id, region_id) of the regions that contain each point.

    ``points``: point_id, latitude, longitude; unusable positions match nothing, longitudes beyond 180 wrap around. Repeated
    rows give one pair; empty sides give an empty result; further columns are ignored. A point on a circle's rim is inside;
    edges of polygons are straight in degrees and a ring need not be closed.
    """
    usable = (
        points.where(usable_position(F.col("latitude"), F.col("longitude")))
        .select(F.col("point_id").cast("bigint"), F.col("latitude").alias("lat"), wrap_longitude(F.col("longitude")).alias("lon"))
        .withColumn("strip", F.floor(F.col("lat") / STRIP_DEGREES).cast("int"))
    )
    boxes = regions_with_bounds(regions).select(*(c.split()[0] for c in _REGION.split(", ")))
    left, right = _dealt(usable, boxes, ["point_id", "lon"], ["region_id"], points_per_task, regions_per_task)
    return (
        left.groupBy("strip", "i", "j").cogroup(right.groupBy("strip", "i", "j"))
        .applyInPandas(_sweep, "point_id bigint, region_id bigint").distinct()
    )


def _dealt(left: DataFrame, right: DataFrame, left_key: list[str], right_key: list[str], left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (i, j), the parts of each strip's rows that meet in one task; strips that one side lacks are dropped."""
    count = lambda df, out, rows: df.groupBy("strip").agg(F.ceil(F.count("*") / rows).cast("int").alias(out))
    parts = cut_small(count(left, "m", left_rows).join(count(right, "n", right_rows), "strip"))
    dealt = []
    for df, key, own, other in ((left, left_key, ("i", "m"), ("j", "n")), (right, right_key, ("j", "n"), ("i", "m"))):
        placed = df.join(parts, "strip").withColumn(own[0], F.pmod(F.xxhash64(*key), F.col(own[1])).cast("int"))
        dealt.append(placed.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1))).drop("m", "n"))
    return dealt[0], dealt[1]


def positions(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(position_id, lat, lon), one row for each different usable position, and (point_id, position_id) of all points there.

    The position_id is the smallest point_id at the position. Null ids and unusable positions are left out.
    """
    usable = points.where(F.col("point_id").isNotNull() & usable_position(F.col("latitude"), F.col("longitude"))).select(
        F.col("point_id").cast("bigint"), F.col("latitude").alias("lat"), wrap_longitude(F.col("longitude")).alias("lon")
    )
    classes = cut(usable.groupBy("lat", "lon").agg(F.min("point_id").alias("position_id")))
    return classes.select("position_id", "lat", "lon"), usable.join(classes, ["lat", "lon"]).select("point_id", "position_id").distinct()


def _near_sweep(metres: float):
    def run(upper: pd.DataFrame, lower: pd.DataFrame) -> pd.DataFrame:
        """Pairs of an upper point and a lower one that lies south of it, or at its latitude with a larger id."""
        found = []
        lower = lower.sort_values("lon", kind="stable")
        lon, lat, ids = (lower[c].to_numpy() for c in ("lon", "lat", "position_id"))
        reach = math.degrees(metres / EARTH_RADIUS_M) + 1e-9
        edge = np.minimum(np.abs(upper["lat"].to_numpy()) + reach, 90.0)
        # the widest span of longitude within the distance; near a pole all of it
        ratio = np.sin(np.radians(reach)) / np.maximum(np.cos(np.radians(np.abs(upper["lat"].to_numpy()))), 1e-12)
        half = np.where((edge >= 90) | (ratio >= 1), 360.0, np.degrees(np.arcsin(np.minimum(1.0, ratio)))) + 1e-7
        east, north, own = upper["lon"].to_numpy(), upper["lat"].to_numpy(), upper["position_id"].to_numpy()
        for turn in (-360.0, 0.0, 360.0):
            first, last = np.searchsorted(lon, east + turn - half, "left"), np.searchsorted(lon, east + turn + half, "right")
            if turn:  # a span of all longitudes is swept once
                last = np.where(half >= 360, first, last)
            for start in range(0, len(own), 2000):
                sizes = (last - first)[start : start + 2000]
                at = np.repeat(np.arange(start, start + len(sizes)), sizes)
                to = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[start : start + 2000], sizes)
                keep = (lat[to] < north[at]) | ((lat[to] == north[at]) & (ids[to] > own[at]))
                keep &= north[at] - lat[to] <= reach
                at, to = at[keep], to[keep]
                a, b = np.radians(north[at]), np.radians(lat[to])
                h = np.sin((a - b) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(east[at] - lon[to]) / 2) ** 2
                d = 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))
                near = d <= metres
                found.append((own[at][near], ids[to][near], d[near]))
        a, b, d = (np.concatenate([np.empty(0, kind), *(p[k] for p in found)]) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        return pd.DataFrame({"id_a": np.minimum(a, b), "id_b": np.maximum(a, b), "metres": d})

    return run


def near_pairs(places: DataFrame, metres: float, per_task: int = NEAR_PER_TASK) -> DataFrame:
    """(id_a, id_b, metres), smaller id first: all pairs of different positions within ``metres`` of each other.

    ``places``: position_id, lat, lon as from ``positions``. The distance is that of the great circle. Each pair has one
    owner, the strip of its northern point; pairs across the date line and around the poles are found. Points at one
    position are one row here, so a place that holds a third of all points makes no pairs of its own.
    """
    height = max(math.degrees(metres / EARTH_RADIUS_M) * 1.001, STRIP_DEGREES / 64)
    strip = F.floor((F.col("lat") + 90) / height).cast("int")
    upper = places.select("position_id", "lat", "lon", strip.alias("strip"))
    # a point's southern partners lie in its own strip or in the one below
    lower = places.select(*(F.col(c).alias(c) for c in ("position_id", "lat", "lon")), F.explode(F.array(strip, strip + 1)).alias("strip"))
    left, right = _dealt(upper, lower, ["position_id"], ["position_id"], per_task, per_task)
    return left.groupBy("strip", "i", "j").cogroup(right.groupBy("strip", "i", "j")).applyInPandas(_near_sweep(metres), "id_a bigint, id_b bigint, metres double")
