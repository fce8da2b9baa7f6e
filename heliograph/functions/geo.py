"""Column expressions on positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8


def usable_position(lat: Column, lon: Column) -> Column:
    """True where both numbers are finite, not both 0, latitude within 90 and longitude within 360 degrees; never null."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    ok = finite(lat) & finite(lon) & ~((lat == 0) & (lon == 0)) & (F.abs(lat) <= 90) & (F.abs(lon) <= 360)
    return F.coalesce(ok, F.lit(False))


def wrap_longitude(lon: Column) -> Column:
    """``lon`` moved into [-180, 180)."""
    return F.when((lon >= -180) & (lon < 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)
