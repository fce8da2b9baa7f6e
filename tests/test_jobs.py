"""Files, EXIF fields, batches that call services, and the loop over due tasks."""

import json
import struct
from datetime import datetime

from pyspark.sql import functions as F

from heliograph.catalog import Catalog
from heliograph.operators import jobs
from heliograph.schema import PARENTS_FIRST
from heliograph.sources import exif, exports, files

NOW = "2024-01-15T00:00:00"


def picture(order="<", wide=640, high=480):
    """A JPEG of headers only, with EXIF fields."""
    text = lambda s: s.encode() + b"\0"
    fraction = lambda *v: struct.pack(f"{order}{len(v)}I", *v)
    short = lambda v: struct.pack(order + "H", v)
    sets = [
        [(0x010F, 2, text("Acme")), (0x0110, 2, text("One two three")), (0x0112, 3, short(6)), (0x8769, 4, None), (0x8825, 4, None)],
        [(0x829A, 5, fraction(10, 1250)), (0x829D, 5, fraction(28, 10)), (0x8827, 3, short(400)), (0x9003, 2, text("2021:05:06 07:08:09")), (0x9011, 2, text("+02:00")), (0x927C, 7, b"x" * 2000)],
        [(1, 2, text("S")), (2, 5, fraction(10, 1, 30, 1, 0, 1)), (3, 2, text("E")), (4, 5, fraction(20, 1, 0, 1, 36, 1))],
    ]
    sizes = {2: 1, 3: 2, 4: 4, 5: 8, 7: 1}
    starts, at = [], 8
    for fields in sets:
        starts.append(at)
        at += 2 + 12 * len(fields) + 4
    body, rest = b"", b""
    for fields in sets:
        body += struct.pack(order + "H", len(fields))
        for tag, kind, data in fields:
            data = struct.pack(order + "I", starts[1 if tag == 0x8769 else 2]) if data is None else data
            place = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", at + len(rest))
            rest += data if len(data) > 4 else b""
            body += struct.pack(order + "HHI", tag, kind, len(data) // sizes[kind]) + place
        body += struct.pack(order + "I", 0)
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + body + rest
    app1 = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, high, wide) + b"\x01\x01\x11\x00\xff\xd9"


def test_exif():
    for order in "<>":
        found = exif.read(picture(order))
        assert (found["width"], found["height"], found["camera_make"], found["camera_model"], found["exif_orientation"]) == (640, 480, "Acme", "One two three", 6)
        assert (found["shutter_speed"], found["aperture"], found["iso"], found["taken_at"]) == ("1/125", 2.8, 400, "2021:05:06 07:08:09")
        assert found["gps_latitude"] == -10.5 and abs(found["gps_longitude"] - 20.01) < 1e-9
        held = json.loads(found["all_exif"])
        assert held["primary:OffsetTimeOriginal"] == "+02:00" and held["primary:MakerNote"] == {"type": "binary", "size": 2000}
    for cut in range(0, len(picture()), 7):
        exif.read(picture()[:cut])  # cut files give what they hold
    assert exif.read(b"") == exif.read(b"no image") == {"width": None, "height": None}


def test_scan_and_listings(spark, tmp_path):
    (tmp_path / "b" / ".hid").mkdir(parents=True)
    (tmp_path / "b" / "Z.JPG").write_bytes(picture())
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 4))
    (tmp_path / "x.txt").write_bytes(b"text")
    (tmp_path / ".h.jpg").write_bytes(b"")

    def hashes():
        def run(content):
            if content[:1] == b"\x89":
                raise ValueError("no hash")
            return "p"

        return run

    rows = {r["filename"]: r for r in files.scan(spark, str(tmp_path), perceptual=hashes).collect()}
    assert rows["Z.JPG"]["camera_make"] == "Acme" and rows["Z.JPG"]["perceptual_hash"] == "p" and rows["Z.JPG"]["error"] is None and rows["Z.JPG"]["iso"] == 400
    assert (rows["a.png"]["width"], rows["a.png"]["height"], rows["a.png"]["perceptual_hash"], rows["a.png"]["error"]) == (3, 4, None, "perceptual hash: no hash")
    assert [r["name"] for r in files.list_directory(spark, str(tmp_path)).collect()] == ["b", "a.png"]
    assert [r["name"] for r in files.list_directory(spark, str(tmp_path), hidden=True, every=True).collect()] == ["b", ".h.jpg", "a.png", "x.txt"]
    assert files.list_directory(spark, str(tmp_path / "none")).count() == 0
    assert files.trash_files(spark, str(tmp_path)).agg(F.sum("size")).first()[0] == 24 + 4
    thumbs = files.thumbnails(spark.createDataFrame([("/a", 90, b"abc")], "path string, rotation int, content binary"), lambda: lambda b, r: b[:1] * (r // 90))
    assert [bytes(r["thumbnail"]) for r in thumbs.collect()] == [b"a"]


def test_describe_stops_calling_a_service_that_is_down(spark):
    def load():
        def run(path, prompt):
            if path == "/bad" or int(path[1:]) > 4:
                raise ConnectionError("down")
            return f"{prompt} {path}", ["a"]

        return run

    photos = spark.createDataFrame([(k, f"/{k}", "see", None, None, None) for k in range(10)], "id bigint, path string, prompt string, description string, tags string, llm_processed_at string").coalesce(1)
    rows = {r["id"]: r for r in jobs.describe(photos.orderBy("id"), load, workers=1).collect()}
    errors = [r["error"] for r in rows.values()]
    assert errors.count(None) == 5 and errors.count("down") >= 3 and errors.count("down") + errors.count("unavailable") == 5
    saved = {r["id"]: r for r in jobs.save_descriptions(photos, jobs.describe(photos, load), NOW).collect()}
    assert saved[1]["description"] == "see /1" and saved[1]["tags"] == '["a"]' and saved[1]["llm_processed_at"] == NOW and saved[9]["description"] is None


def test_faces_of_a_batch(spark):
    def load():
        def run(content):
            if content == b"broken":
                raise ValueError
            return [(1, 2, 3, 4, 0.9, [1.0, 2.0])] * len(content)

        return run

    photos = spark.createDataFrame([(1, b"ab"), (2, b""), (3, b"broken")], "id bigint, content binary")
    faces, scans = jobs.find_faces(photos, load, NOW)
    assert [(r["photo_id"], r["bbox_w"], r["embedding_dim"]) for r in faces.collect()] == [(1, 3, 2)] * 2
    assert sorted((r["photo_id"], r["faces_found"]) for r in scans.collect()) == [(1, 2), (2, 0)]


def test_loop_and_trash(spark):
    tasks = spark.createDataFrame(
        [(1, "scan", "2024-01-01T00:00:00", None, None, "pending"), (2, "faces", "2024-01-02T00:00:00", None, None, "pending"), (3, "odd", "2024-01-03T00:00:00", None, None, "pending"), (4, "scan", "2025-01-01T00:00:00", None, None, "pending"), (5, "scan", "2024-01-01T00:00:00", 3, 5, "pending")],
        "id bigint, task_type string, scheduled_at string, hours_start int, hours_end int, status string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("started_at", "completed_at", "error_message")})
    ran = []

    def broken(row):
        raise RuntimeError("no model")

    done = {r["id"]: (r["status"], r["error_message"]) for r in jobs.run_due(tasks, {"scan": lambda row: ran.append(row["id"]), "faces": broken}, datetime(2024, 1, 15)).collect()}
    assert ran == [1] and done == {1: ("completed", None), 2: ("failed", "no model"), 3: ("failed", "unknown task type odd"), 4: ("pending", None), 5: ("pending", None)}
    photos = spark.createDataFrame([(1, "/t/1", "/1", 5, "2023-12-16T00:00:00+00:00"), (2, "/t/2", "/2", 5, "2023-12-15T23:59:59+00:00"), (3, "/3", None, 5, None)], "id bigint, path string, original_path string, size_bytes bigint, trashed_at string")
    stay, gone = jobs.expire_trash(photos, NOW)
    assert sorted(r["id"] for r in stay.collect()) == [1, 3] and [r["id"] for r in gone.collect()] == [2]
    assert jobs.Settings.of({"trash_days": 7, "unknown": 1}).trash_days == 7 and jobs.Settings().similarity_threshold == 50


def test_export_counts_and_catalogue_copy(spark, tmp_path):
    photos = spark.read.parquet("/root/testdata/sf0.001/photos.parquet")
    assert exports.export(photos, str(tmp_path / "csv"), "csv") == photos.count() and exports.export(photos, str(tmp_path / "html"), "html") == photos.count()
    assert exports.export(photos.limit(0), str(tmp_path / "json"), "json") == 0
    old, new = Catalog(spark, str(tmp_path / "old")), Catalog(spark, str(tmp_path / "new"))
    old.commit("photos", photos.limit(20))
    old.commit("people", spark.createDataFrame([(3, "Ann", NOW, NOW)], "id bigint, name string, created_at string, updated_at string"))
    copied = exports.copy_catalogue(old, new)
    assert copied["photos"] == 20 and copied["people"] == 1 and set(copied) == set(PARENTS_FIRST)
    assert exports.copy_catalogue(old, new)["photos"] == 0
    tops = {r["table_name"]: r["top"] for r in exports.watermarks(new).collect()}
    assert tops["people"] == 3 and tops["faces"] == 0 and len(tops) == 10
