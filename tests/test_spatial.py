"""Points in regions against a plain double loop."""

import math
import random

import pytest

from heliograph.functions.geo import EARTH_RADIUS_M
from heliograph.operators import spatial
from heliograph.operators.spatial import points_in_regions

REGION = "region_id bigint, shape string, latitude double, longitude double, radius_m double, ring_lat array<double>, ring_lon array<double>"


def inside(lat, lon, r):
    _, shape, la, lo, radius, ys, xs = r
    if shape == "circle":
        h = math.sin(math.radians(lat - la) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(la)) * math.sin(math.radians(lon - lo) / 2) ** 2
        return 2 * EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h))) <= radius
    for turn in (-360, 0, 360):
        odd = False
        for k in range(len(ys)):
            if (ys[k] > lat) != (ys[k - 1] > lat) and lon + turn < xs[k] + (lat - ys[k]) * (xs[k - 1] - xs[k]) / (ys[k - 1] - ys[k]):
                odd = not odd
        if odd:
            return True
    return False


def test_against_double_loop(spark):
    rng = random.Random(4)
    regions = [
        (1, "circle", 88.9, 40.0, 200_000.0, None, None), (2, "circle", -17.0, 179.99, 5_000.0, None, None), (3, "polygon", -43.9, 179.9, None, [-44.5, -44.5, -43.0, -43.2], [179.0, 181.0, 180.5, 179.2]),
        (4, "circle", 0.1, 0.1, 30_000.0, None, None), (5, "polygon", 0.0, 0.0, None, [-1.0, 2.0, 2.0, -1.0], [-1.0, -1.0, 2.0, 2.0]), (6, "circle", -89.99, 0.0, 100_000.0, None, None), (7, "circle", 0.1, 0.1, 30_000.0, None, None),
    ]
    centres = [(88.9, 40), (89.9, -130), (-17, 180), (-44, 180), (0, 0), (-89.5, 90), (0.1, 0.1)]
    points = [(k, max(-90.0, min(90.0, c[0] + rng.gauss(0, 0.4))), c[1] + rng.gauss(0, 0.4) + rng.choice([0, 0, 360 if c[1] < 0 else -360])) for k, c in ((k, rng.choice(centres)) for k in range(600))]
    points += [(1000 + k, 0.1, 0.1) for k in range(40)] + [(2000, 0.1, 0.1), (2000, 0.1, 0.1)]
    expected = {(p, r[0]) for p, la, lo in points for r in regions if abs(lo) <= 360 and inside(la, (lo + 180) % 360 - 180, r)}
    bad = [(3001, None, 0.1), (3002, 0.1, None), (3003, 0.0, 0.0), (3004, 95.0, 0.1), (3005, 0.1, 361.0), (3006, float("nan"), 0.1), (3007, 0.1, float("inf"))]
    df = spark.createDataFrame([(*p, "x") for p in points + bad], "point_id bigint, latitude double, longitude double, strip string")
    regions += [(8, "circle", None, 0.0, 5.0, None, None), (9, "circle", 0.0, 0.0, None, None, None), (10, "polygon", 0.0, 0.0, None, [0.0, 1.0], [0.0, 1.0]), (11, "square", 0.1, 0.1, 9e9, None, None), (12, None, 0.1, 0.1, 9e9, None, None)]
    places = spark.createDataFrame([(*r, 1, 2, "x") for r in regions], REGION + ", salts int, salt int, south string")
    got = [tuple(r) for r in points_in_regions(df, places).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    split = {tuple(r) for r in points_in_regions(df, places, points_per_task=20).collect()}
    assert split == expected


def test_empty(spark):
    points = spark.createDataFrame([], "point_id bigint, latitude double, longitude double")
    places = spark.createDataFrame([], REGION)
    some = spark.createDataFrame([(1, 0.5, 0.5)], "point_id bigint, latitude double, longitude double")
    assert points_in_regions(points, places).count() == 0 and points_in_regions(some, places).count() == 0


def distance(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[2] - b[2]) / 2) ** 2
    return 2 * spatial.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize(("metres", "per_task"), [(30_000.0, 10_000), (30_000.0, 7), (2_000_000.0, 40)])
def test_near_pairs(spark, metres, per_task):
    """Against all pairs: around the date line, the poles, an equator and one crowded place."""
    rng = random.Random(int(metres) + per_task)
    centres = [(0.0, 179.99), (89.95, 10.0), (-89.9, -100.0), (47.0, 8.0), (47.01, 8.01)]
    rows = []
    for k in range(160):
        la, lo = rng.choice(centres)
        rows.append((k, max(-90.0, min(90.0, la + rng.uniform(-0.3, 0.3))), lo + rng.uniform(-0.4, 0.4), "clash"))
    rows += [(200 + k, 47.0, 8.0, "clash") for k in range(80)] + [(300, 47.0, 8.0, "x"), (301, None, 1.0, "x"), (302, 91.0, 1.0, "x"), (None, 47.0, 8.0, "x")]
    places, members = spatial.positions(spark.createDataFrame(rows + rows[:9], "point_id bigint, latitude double, longitude double, lat string"))
    assert sorted(r[0] for r in members.where("position_id = 200").collect()) == [*range(200, 280), 300]
    held = [tuple(r) for r in places.collect()]
    expected = {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(held) for b in held[:i] if distance(a, b) <= metres}
    got = [(r[0], r[1]) for r in spatial.near_pairs(places, metres, per_task).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 50
    assert spatial.near_pairs(places.limit(0), metres).count() == 0
