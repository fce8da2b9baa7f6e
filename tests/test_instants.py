"""Timestamps against an independent reading with zoneinfo."""

import json
import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from heliograph.operators import timestamps as T

SCHEMA = "id bigint, path string, taken_at string, modified_at string, scanned_at string, all_exif string, root_dir string"


def resolved(spark, rows, zone="UTC"):
    df = spark.createDataFrame([(k, t, z) for k, (t, z) in enumerate(rows)], "k int, t string, z string")
    return [r["utc_us"] for r in T.resolve(df, "t", F.coalesce("z", F.lit(zone))).orderBy("k").collect()]


def us(text):
    return round((datetime.fromisoformat(text) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1_000_000)


def test_shapes(spark):
    cases = [
        ("2020-10-03T12:07:35Z", None, "2020-10-03T12:07:35+00:00"), ("2013-02-22T05:26:51z", None, "2013-02-22T05:26:51+00:00"), ("28.09.2012 17:17:01", "Europe/Berlin", "2012-09-28T15:17:01+00:00"),
        ("20180425_031552", "Asia/Tokyo", "2018-04-24T18:15:52+00:00"), ("2013:02:22 14:26:51+09:00", None, "2013-02-22T05:26:51+00:00"), ("20200514T015529Z", None, "2020-05-14T01:55:29+00:00"),
        ("2020-09-11 10:14:23 PDT", None, "2020-09-11T17:14:23+00:00"), ("Fri, 12 Jan 2018 02:10:53 +0000", None, "2018-01-12T02:10:53+00:00"), ("1462952636", None, "2016-05-11T07:43:56+00:00"),
        ("1570594139074", None, "2019-10-09T04:08:59.074+00:00"), ("1605385108.125", None, "2020-11-14T20:18:28.125+00:00"), ("Mar 10, 2024 5:10:17 AM", "UTC", "2024-03-10T05:10:17+00:00"),
        ("Nov 11, 2019 12:10:29 PM", "UTC", "2019-11-11T12:10:29+00:00"), ("Jul 16, 2024 12:31:14 AM", "UTC", "2024-07-16T00:31:14+00:00"), ("2015:03:04 07:00", "UTC", "2015-03-04T07:00:00+00:00"),
        ("2015:12:30 13:56:11.446551833", "UTC", "2015-12-30T13:56:11.446551+00:00"), ("2016-02-27T09:39:48+01", None, "2016-02-27T08:39:48+00:00"), ("2021-11-05T03:55:28[America/Phoenix]", None, "2021-11-05T10:55:28+00:00"),
        ("2022-10-28 22:09:02 America/New_York", None, "2022-10-29T02:09:02+00:00"), ("2016-12-09T02:47:48-03:30", None, "2016-12-09T06:17:48+00:00"), ("2022/09/16 03:33:59", None, "2022-09-16T03:33:59+00:00"),
        ("  2020-01-02 03:04:05  ", "-02:30", "2020-01-02T05:34:05+00:00"), ("2020-10-25 02:30:00 CEST", None, "2020-10-25T00:30:00+00:00"),
    ]
    assert resolved(spark, [c[:2] for c in cases]) == [us(c[2]) for c in cases]


def test_no_instant(spark):
    cases = [
        (None, None), ("", None), ("unknown", None), ("2014-02-02", None), ("2021:06", None), ("0000:00:00 00:00:00", None), ("    :  :     :  :  ", None), ("2021-02-30 10:00:00", None), ("2021-01-01 24:00:00", None),
        ("2021-01-01 10:60:00", None), ("2021-01-01 10:00:00 XYZT", None), ("2020-10-25 02:30:00", "Europe/Berlin"), ("2020-03-29 02:30:00", "Europe/Berlin"), ("x" * 100_000, None), ("9" * 5000, None),
    ]
    assert resolved(spark, cases) == [None] * len(cases)


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([("2020-01-01T00:00:00Z", 1, "a")] * 3, "t string, wall_us int, _zone string").withColumns({"zone_text": F.lit(1), "_default": F.lit(2), "utc_us": F.lit("old")})
    got = T.resolve(df, "t", F.lit("UTC")).collect()
    assert len(got) == 3 and {tuple(sorted(r.asDict().items())) for r in got} == {(("_default", 2), ("_zone", "a"), ("t", "2020-01-01T00:00:00Z"), ("utc_us", us("2020-01-01T00:00:00+00:00")), ("wall_us", 1), ("zone_text", 1))}


def test_changes_of_every_zone(spark):
    """Every half hour around the changes of a year, against zoneinfo with both folds."""
    rows, expected = [], []
    for name in ("Europe/Berlin", "America/St_Johns", "Australia/Adelaide", "Asia/Kathmandu", "Australia/Lord_Howe"):
        zone = ZoneInfo(name)
        for first in (datetime(2021, 3, 10), datetime(2021, 10, 1), datetime(2021, 11, 5)):
            for k in range(0, 30 * 48):
                wall = first + timedelta(minutes=30 * k)
                folds = {w.astimezone(UTC) for w in (wall.replace(tzinfo=zone, fold=f) for f in (0, 1))}
                real = [x for x in folds if x.astimezone(zone).replace(tzinfo=None) == wall]
                rows.append((wall.isoformat(sep=" "), name))
                expected.append(us(real[0].isoformat()) if len(real) == 1 else None)
    assert resolved(spark, rows) == expected


def test_estimate_finds_undeclared_zone(spark):
    """A source without a declared zone gets the one that its rows' offsets agree with; a clean declaration stands."""
    zone = ZoneInfo("America/Denver")
    sources = spark.createDataFrame([("/a", None), ("/b", "Asia/Tokyo"), ("/c", "America/Denver"), ("/c/deep", "UTC")], "root_dir string, time_zone string")
    rows = []
    for k in range(60):
        wall = datetime(2020, 1, 5, 12) + timedelta(days=6 * k)
        offset = wall.replace(tzinfo=zone).strftime("%z")
        exif = json.dumps({"primary:OffsetTimeOriginal": f"{offset[:3]}:{offset[3:]}"}) if k % 2 else None
        rows.append((k, f"/a/{k}.jpg", wall.strftime("%Y:%m:%d %H:%M:%S"), (wall.replace(tzinfo=zone).astimezone(UTC) + timedelta(minutes=5)).strftime("%Y-%m-%dT%H:%M:%S"), None, exif, "clash"))
    rows.append((100, "/c/deep/x.jpg", "2020:07:01 10:00:00", None, None, None, "clash"))
    rows.append((101, "/abc/x.jpg", "2020:07:01 10:00:00", None, None, '{"primary:Off', "clash"))
    photos = spark.createDataFrame(rows, SCHEMA).drop("root_dir")
    got = {r["root_dir"]: r["time_zone"] for r in T.source_zones(photos, sources).collect()}
    assert got == {"/a": "America/Denver", "/b": "Asia/Tokyo", "/c": "America/Denver", "/c/deep": "UTC"}
    found = {(r["photo_id"]): r["utc_us"] for r in T.normalise(photos, sources).where("field_name = 'taken_at'").collect()}
    assert found[2] == us("2020-01-17T19:00:00+00:00") and found[100] == us("2020-07-01T10:00:00+00:00") and found[101] is None
    assert len(found) == 62


def test_all_zones_are_tried_from_both_sides(spark):
    """A source beside one that declares Berlin: stated offsets of Nepal; wall clocks minutes before their ingestion; noise."""
    hour = 3_600_000_000
    sources = spark.createDataFrame([("/nepal", None), ("/berlin", "Europe/Berlin"), ("/late", None), ("/noise", None), ("/wrong", "Asia/Tokyo"), ("/none", None)], "root_dir string, time_zone string")
    walls = [us("2021-01-01T00:00:00+00:00") + k * 40 * hour for k in range(400)]
    rows = [("/nepal", w, 345 * 60_000_000, None) for w in walls] + [("/berlin", walls[0], hour, None)]
    # the floors of New York, in summer and winter time, a little below its offsets
    for w in walls:
        off = datetime.fromtimestamp(w / 1e6, UTC).replace(tzinfo=None).replace(tzinfo=ZoneInfo("America/New_York")).utcoffset()
        rows += [("/late", w, None, int(off.total_seconds() * 1e6) - 600_000_000)]
    rows += [("/noise", w, (k * 37 % 1400 - 700) * 60_000_000 + 60_000_000 * 7, None) for k, w in enumerate(walls)]
    rows += [("/wrong", w, hour * 5 + hour // 2, None) for w in walls]
    got = {r["root_dir"]: r for r in T.estimate_zones(spark.createDataFrame(rows, "root_dir string, wall_us bigint, offset_us bigint, floor_us bigint"), sources).collect()}
    assert got["/nepal"]["time_zone"] in ("Asia/Kathmandu", "Asia/Katmandu") and got["/nepal"]["violations"] == 0
    assert got["/berlin"]["time_zone"] == "Europe/Berlin" and got["/wrong"]["time_zone"] in ("Asia/Calcutta", "Asia/Colombo", "Asia/Kolkata")
    offsets = {ZoneInfo(got["/late"]["time_zone"]).utcoffset(datetime(2021, m, 10)) for m in (1, 7)}
    assert offsets == {timedelta(hours=-5), timedelta(hours=-4)} and got["/late"]["violations"] == 0
    assert got["/noise"]["time_zone"] is None and got["/noise"]["violations"] > 200 and got["/none"]["time_zone"] is None and got["/none"]["estimated"] is None


def test_empty(spark):
    photos = spark.createDataFrame([], SCHEMA)
    sources = spark.createDataFrame([], "root_dir string, time_zone string")
    assert T.normalise(photos.drop("root_dir"), sources).count() == 0


def test_whole_table_against_plain_python(spark):
    """Every case of the smallest catalogue against a separate reading of its texts."""
    from heliograph.plans.catalogue_queries import p1_found

    root = "/root/testdata/sf0.001"
    zones = {r["root_dir"]: r["time_zone"] for r in spark.read.parquet(f"{root}/library_roots.parquet").collect()}
    got = {(r[0], r[1]): r[2] for r in p1_found(spark, root).collect()}
    checked = 0
    for p in spark.read.parquet(f"{root}/photos.parquet").collect():
        m = re.fullmatch(r"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)", p["taken_at"] or "")
        if not m:
            continue
        try:
            wall = datetime(*map(int, m.groups()))
        except ValueError:
            assert (p["id"], "taken_at") not in got
            continue
        try:
            offset = json.loads(p["all_exif"] or "{}").get("primary:OffsetTimeOriginal")
        except ValueError:
            offset = None
        if offset:
            expected = us(wall.isoformat() + offset)
        else:
            zone = ZoneInfo(zones["/".join(p["path"].split("/")[:3])])
            real = {w.astimezone(UTC) for w in (wall.replace(tzinfo=zone, fold=f) for f in (0, 1)) if w.astimezone(UTC).astimezone(zone).replace(tzinfo=None) == wall}
            expected = us(next(iter(real)).isoformat()) if len(real) == 1 else None
        assert got.get((p["id"], "taken_at")) == expected, p["taken_at"]
        checked += 1
    assert checked > 50
