"""Catalogue operators on a small hand-made catalogue."""

import random

import pytest
from pyspark.sql import functions as F

from heliograph import schema
from heliograph.catalog import Catalog, assign_ids, cascade
from heliograph.functions import exprs as X
from heliograph.functions import hashes as H
from heliograph.operators import duplicates, lookups, mutations, pipelines, relations, search
from heliograph.sources import exports, files
from heliograph.streaming import ingest

NOW = "2025-01-01T00:00:00"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in _types(values).items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def _types(values):
    return {k: "string" if isinstance(v, str) or v is None else "array<double>" if isinstance(v, list) else "double" if isinstance(v, float) else "int" for k, v in values.items()}


@pytest.fixture(scope="module")
def photos(spark):
    rows = [
        (1, "/a/b/x.jpg", "x.jpg", "/a/b", 3_250_000, 4032, 3024, "2024-11-20 14:35:00", "h1", False, None, '["vacation"]', "A beach. Sunset"),
        (2, "/a/bc/y.jpg", "y.jpg", "/a/bc", 3_250_000, 4032, 3024, None, "h1", False, None, "[]", None),
        (3, "/a/b/sub/z (1).jpg", "z (1).jpg", "/a/b/sub", 10, None, 5, "2024:11:20 14:35:00", "h2", True, None, "", None),
        (4, "/a/b_/w.jpg", "w.jpg", "/a/b_", 10, 100, 100, "nonsense", "h2", True, "2024-01-01T00:00:00+00:00", None, "Beach, twice beach"),
        (5, "/a/b/v.jpg", "v.jpg", "/a/b", 10, 100, 100, None, "h2", None, None, "broken", ""),
        (6, "/a/b/u.jpg", "u.jpg", "/a/b", None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id bigint, path string, filename string, directory string, size_bytes bigint, width int, height int, taken_at string, sha256_hash string, marked_for_deletion boolean, trashed_at string, tags string, description string")
    return schema.conform(df, "photos")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_schema(photos):
    assert len(schema.SCHEMAS) == 17 and len(photos.columns) == 34
    assert photos.select("exif_orientation", "user_rotation").distinct().collect() == [(1, 0)]


def test_vectors(spark):
    cos = lambda a, b: one(spark, X.cosine(F.col("a"), F.col("b")), a=a, b=b)
    assert cos([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]) == pytest.approx(1) and cos([1.0, 0.0], [0.0, 1.0]) == 0 and cos([1.0, 0.0], [-1.0, 0.0]) == -1
    assert cos([0.0, 0.0], [1.0, 0.0]) == 0 and cos([1.0], [1.0, 2.0]) == 0
    assert one(spark, X.euclidean(F.col("a"), F.col("b")), a=[0.0, 3.0], b=[4.0, 0.0]) == 5


def test_boxes(spark):
    box = lambda a, b: one(spark, X.iou([F.lit(v) for v in a], [F.lit(v) for v in b]))
    assert box((0, 0, 10, 10), (0, 0, 10, 10)) == 1 and box((0, 0, 10, 10), (20, 20, 10, 10)) == 0 and box((0, 0, 0, 0), (0, 0, 0, 0)) == 0


@pytest.mark.parametrize(("text", "clean"), [("Hello World", "hello-world"), ("Test  Multiple   Spaces", "test-multiple-spaces"), ("Special@#$Characters", "special-characters"), ("", "")])
def test_sanitise(spark, text, clean):
    assert one(spark, X.sanitise(F.lit(text))) == clean


def test_copy_suffix(spark):
    names = {"photo (1).jpg": True, "photo-copy.jpg": True, "IMG_1234.jpg": True, "a (1) (b).jpg": False, "plain.jpg": False, "x-7.png": True, "Copy of x.jpg": True}
    got = {r["n"]: r["c"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", X.copy_suffix(F.col("n")).alias("c")).collect()}
    assert got == names


def test_hash_spellings(spark):
    import base64

    raw = bytes(range(1, 33))
    b64 = base64.b64encode(raw).decode()
    spelt = [b64, b64.rstrip("="), b64.replace("+", "-").replace("/", "_"), raw.hex(), raw.hex().upper(), f" {b64}\r\n"]
    bad = [None, "", "ERR", "hash failed", b64[:20], base64.b64encode(bytes(32)).decode(), "0" * 64, base64.b64encode(bytes(31)).decode(), "x" * 10_000]
    df = spark.createDataFrame([(s,) for s in spelt + bad], "s string").select(H.perceptual_bits(F.col("s")).alias("b"))
    assert [r["b"] for r in df.collect()] == [bytearray(raw)] * len(spelt) + [None] * len(bad)
    sha = spark.createDataFrame([(s,) for s in (raw.hex(), f"sha256:{raw.hex().upper()} ", f"{raw.hex()}\n", "00")], "s string").select(H.sha256_bytes(F.col("s")).alias("b"))
    assert [r["b"] for r in sha.collect()] == [bytearray(raw)] * 3 + [None]


def test_base64_that_begins_like_a_prefix_is_whole(spark):
    import base64

    texts = ["0x" + "Ab3" * 13 + "bA=", "0X" + "9zQ" * 13 + "9A", "0x" + "ab" * 32, "sha256-" + "Q" * 35 + "A="]
    raw = [base64.b64decode(texts[0]), base64.b64decode(texts[1] + "="), bytes.fromhex("ab" * 32)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r["b"] for r in df.select(H.perceptual_bits(F.col("s")).alias("b")).collect()][:3] == [bytearray(x) for x in raw]
    assert [r["b"] for r in df.select(H.sha256_bytes(F.col("s")).alias("b")).collect()] == [*(bytearray(x) for x in raw), bytearray(base64.urlsafe_b64decode(texts[3]))]


def test_counters_grow_past_three_digits(spark):
    files = spark.range(1200).select(F.format_string("/a/%05d.jpg", "id").alias("path"), F.lit("x.jpg").alias("filename"), F.lit(0).alias("mtime_s"))
    names = [r[0] for r in pipelines.rename_plan(files, "{name}-{counter}.{ext}").select("new_name").collect()]
    assert len(set(names)) == 1200 and "x-007.jpg" in names and "x-1200.jpg" in names


def test_scores_and_keep_best(photos):
    scores = {r["id"]: r["s"] for r in photos.select("id", X.quality_score(F.col("width"), F.col("height"), F.col("size_bytes"), F.col("taken_at")).alias("s")).collect()}
    assert scores == {1: 1219 + 32 + 10, 2: 1251, 3: 10, 4: 11, 5: 1, 6: 0}
    groups = duplicates.exact_groups(photos)
    assert {(r["sha256_hash"], r["id"]): r["pos"] for r in groups.collect()} == {("h1", 2): 1, ("h1", 1): 2, ("h2", 5): 1, ("h2", 3): 2, ("h2", 4): 3}
    assert {r["id"]: r["delete"] for r in duplicates.keep_best(groups, "sha256_hash").collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
    assert ids(duplicates.remove_members(groups, "sha256_hash", photos.where("id = 1"))) == [3, 4, 5]


def test_prefix_rules(photos):
    assert ids(lookups.undescribed(photos, "/a/b", "prefix")) == [2, 3, 6] and ids(lookups.undescribed(photos, "/a/b", "exact", 5)) == [6]
    assert ids(relations.without(photos, photos.where("id < 0").select(F.col("id").alias("photo_id")), directory="/a/b")) == [1, 3, 5, 6]
    assert ids(lookups.with_empty_tags(photos.withColumn("llm_processed_at", F.lit(NOW)))) == [2, 3, 4, 6]


def test_word_search(photos):
    hits = search.by_words(photos, "beach beach Twice", 10).collect()
    assert [(r["id"], round(r["similarity"], 4)) for r in hits] == [(4, 1.0), (1, 0.6667)]
    assert search.by_words(photos, "  ", 10).count() == 0


def test_vector_search_shrinks_below_k(spark, photos):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (99, [1.0, 0.0]), (3, [0.0, 0.0])], "photo_id bigint, embedding array<float>")
    hits = search.by_vector(vectors, [1.0, 0.0], 2, 0.2)
    assert ids(hits, "photo_id") == [1, 99] and ids(search.with_photos(hits, photos), "photo_id") == [1]


def test_division(spark):
    bridge = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 2)], "photo_id bigint, tag_id bigint")
    assert ids(relations.smart_album(bridge, [1, 2]), "photo_id") == [1] and relations.smart_album(bridge, []).count() == 0 and relations.smart_album(bridge, [1, 1]).count() == 0


def test_hours(spark):
    at = lambda h, s, e: one(spark, X.within_hours(F.lit(h), F.lit(s).cast("int"), F.lit(e).cast("int")))
    assert at(9, 9, 17) and not at(17, 9, 17) and at(23, 22, 6) and at(5, 22, 6) and not at(6, 22, 6) and not at(8, 8, 8) and at(3, None, 5)


def test_leaders_equal_sequential_loop(spark):
    rng = random.Random(2)
    for _ in range(3):
        n = 60
        edges = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.06}
        expected = {}
        for k in range(n):
            led = [i for i in range(k) if expected[i] == i and (i, k) in edges]
            expected[k] = led[0] if led else k
        got = duplicates.leaders(spark.range(n).withColumnRenamed("id", "pos"), spark.createDataFrame(sorted(edges), "i bigint, j bigint")).collect()
        assert {r["pos"]: r["leader"] for r in got} == expected


def test_suppression(spark):
    rows = [(1, 1, 0, 0, 10, 10, 0.9), (2, 1, 1, 1, 10, 10, 0.9), (3, 1, 50, 50, 5, 5, 0.2), (4, 2, 0, 0, 10, 10, None)]
    boxes = spark.createDataFrame(rows, "id bigint, photo_id bigint, bbox_x int, bbox_y int, bbox_w int, bbox_h int, confidence double")
    assert ids(duplicates.box_leaders(boxes, 0.3)) == [1, 3, 4]


def test_changes(spark, photos):
    known = photos.withColumn("modified_at", F.when(F.col("id") < 4, "2024-01-01T00:00:00").when(F.col("id") == 4, "bad"))
    listing = spark.createDataFrame([("/a/b/x.jpg", "2024-01-01 00:00:02"), ("/a/bc/y.jpg", "2024-01-01 00:00:03"), ("/a/b/sub/z (1).jpg", "2020-01-01 00:00:00"), ("/a/b_/w.jpg", "2020-01-01 00:00:00"), ("/new", "2020-01-01 00:00:00")], "path string, t string").select("path", F.col("t").cast("timestamp").alias("mtime"))
    assert {r["path"]: r["change"] for r in pipelines.detect_changes(listing, known).collect()} == {"/a/bc/y.jpg": "modified", "/a/b_/w.jpg": "modified", "/new": "new"}


def test_retention(spark):
    rng = random.Random(3)
    rows = [(f"f{k}", rng.randrange(1000), rng.randrange(100)) for k in range(300)]
    for age, limit in ((500, 5000), (10_000, 0), (10_000, 10**9)):
        expected, left = set(), sorted((m, p, s) for p, m, s in rows)
        expected |= {p for m, p, s in left if m < 1000 - age}
        left = [x for x in left if x[1] not in expected]
        while left and sum(x[2] for x in left) > limit:
            expected.add(left.pop(0)[1])
        got = pipelines.retention(spark.createDataFrame(rows, "path string, mtime_s bigint, size bigint"), 1000, age, limit, 5)
        assert set(ids(got, "path")) == expected


def test_names(spark, photos):
    people = photos.withColumn("people", F.when(F.col("id") == 1, F.array(F.lit("John"), F.lit("Jane"))))
    names = {r["id"]: r["n"] for r in pipelines.filename_parts(people).select("id", pipelines.render_filename(F.lit(1)).alias("n")).collect()}
    assert names[1] == "20241120-1435_vacation_john-jane_a-beach_001.jpg" and names[6] == "{NO_CAT}_u_001.jpg" and names[3].startswith("20241120-1435_001")
    plan = {r["id"]: r["destination"] for r in pipelines.organise(photos, "/lib").collect()}
    assert plan[6].startswith("/lib/unknown/") and len(set(plan.values())) == len(plan)


def test_replies(spark):
    replies = ['{"description": "d", "tags": ["a"]}', 'x ```json\n{"description": "d", "tags": ["a"]}\n```', "A view.\n**Tags:** Sea, *Sun*, ", "no tags", '{"description": "d"}']
    got = pipelines.parse_reply(spark.createDataFrame(list(enumerate(replies)), "k int, text string")).orderBy("k").collect()
    assert [(r["reply_description"], r["reply_tags"]) for r in got] == [("d", ["a"]), ("d", ["a"]), ("A view.", ["sea", "sun"]), ("no tags", []), ("d", [])]


def test_mutations(spark, photos):
    assert mutations.rotate(photos, "/a/b/x.jpg", 270).where("id = 1").first()["user_rotation"] == 270
    moved = mutations.move_to_trash(photos, 1, "/t/1", NOW)
    assert moved.where("id = 1").first()["original_path"] == "/a/b/x.jpg" and mutations.restore(moved, 1).where("id = 1").first()["path"] == "/a/b/x.jpg"
    assert ids(mutations.delete(photos, F.col("marked_for_deletion"))) == [1, 2, 5, 6]
    people = spark.createDataFrame([(3, "Ann", NOW, NOW)], "id bigint, name string, created_at string, updated_at string")
    grown = mutations.find_or_create(people, spark.createDataFrame([("ANN",), ("Bo",), ("bo",)], "name string"), NOW)
    assert {r["id"]: r["name"] for r in grown.collect()} == {3: "Ann", 4: "Bo"}


def test_ids_are_dense(spark):
    fresh = spark.createDataFrame([(f"p{k:03d}",) for k in range(200)], "path string")
    got = assign_ids(fresh, spark.createDataFrame([(41,)], "id bigint"), ["path"]).orderBy("path").collect()
    assert [r["id"] for r in got] == list(range(42, 242))


def test_cascade_and_snapshots(spark, photos, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.commit("photos", photos)
    faces = spark.createDataFrame([(1, 1, 7), (2, 2, 7)], "id bigint, photo_id bigint, person_id bigint").selectExpr("*", "0 bbox_x", "0 bbox_y", "1 bbox_w", "1 bbox_h", "'t' created_at")
    catalog.commit("faces", faces)
    catalog.commit("face_clusters", spark.createDataFrame([(1, 1, "t"), (2, 2, "t")], "id bigint, representative_face_id bigint, created_at string"))
    catalog.commit("face_cluster_members", spark.createDataFrame([(1, 1), (2, 1)], "face_id bigint, cluster_id bigint"))
    changed = cascade("photos", spark.createDataFrame([(1,)], "id bigint"), catalog.table)
    assert ids(changed["photos"]) == [2, 3, 4, 5, 6] and ids(changed["faces"]) == [2] and ids(changed["face_cluster_members"], "face_id") == [2]
    assert {r["id"]: r["representative_face_id"] for r in changed["face_clusters"].collect()} == {1: None, 2: 2}
    assert catalog.version("photos") == 1 and catalog.commit("photos", changed["photos"]) == 2 and catalog.table("photos").count() == 5


def test_files_and_exports(spark, photos, tmp_path):
    source = tmp_path / "in"
    (source / "subdir").mkdir(parents=True)
    for name in ("photo1.jpg", "photo2.PNG", "document.txt", "subdir/photo3.jpeg"):
        (source / name).write_bytes(b"abc")
    assert files.discover(spark, str(source), ["jpg", "jpeg", "png"]).count() == 3
    assert files.content_hashes(spark, str(source)).select("md5_hash").distinct().collect() == [("900150983cd24fb0d6963f7d28e17f72",)]
    exports.write_json(photos, str(tmp_path / "json"))
    exports.write_csv(photos, str(tmp_path / "csv"))
    exports.write_html(photos, str(tmp_path / "html"))
    assert spark.read.json(str(tmp_path / "json")).count() == 6 and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 6
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "html")).collect()]
    assert len(lines) == 8 and sum('class="card"' in line for line in lines) == 6


def test_stream(spark, photos, tmp_path):
    photos.write.parquet(str(tmp_path / "in"))
    seen = []
    query = ingest.watch(spark, str(tmp_path / "in"), photos.schema, lambda df, epoch: seen.append(df.count()), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert sum(seen) == 6


def test_rest_works_without_optional_package(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_extra", lambda: None)
    assert not any(name.startswith(("p2_", "p4_")) for name in entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_photos_alike_up_to_50_bits(spark, monkeypatch):
    from heliograph.plans import registry

    root = "/root/testdata/sf0.001"
    monkeypatch.setattr(duplicates, "GROUP", 60)
    monkeypatch.setattr(duplicates, "BLOCK", 16)
    photos = spark.read.parquet(f"{root}/photos.parquet")
    rows = {r["id"]: (r["path"], int.from_bytes(r["b"], "big")) for r in photos.select("id", "path", H.perceptual_bits(F.col("perceptual_hash")).alias("b")).where("b IS NOT NULL").collect()}
    apart = {(i, j): (rows[i][1] ^ rows[j][1]).bit_count() for i in rows for j in rows if i < j}
    near = {p: n for p, n in apart.items() if n <= 50}
    assert any(n > 16 for n in near.values())
    assert {(r["i"], r["j"]): r["distance"] for r in registry.QUERIES["d12_similar_hashes"](spark, root).collect()} == near
    groups, used, order = set(), set(), sorted(rows, key=lambda k: rows[k][0])
    for k, i in enumerate(order):
        if i not in used:
            members = [i] + [j for j in order[k + 1 :] if j not in used and (min(i, j), max(i, j)) in near]
            used.update(members)
            groups |= {(i, j) for j in members if len(members) > 1}
    assert {(r["group_id"], r["id"]) for r in registry.QUERIES["f7_perceptual_groups"](spark, root).collect()} == groups
    report = registry.QUERIES["f8_duplicate_report"](spark, root).where("group_type = 'perceptual'")
    assert sorted(r["id"] for r in report.collect()) == sorted(j for _, j in groups)


def test_ids_of_many_partitions_are_dense(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        path = F.sha2(F.col("n").cast("string"), 256)
        fresh = spark.range(30_000).select(F.col("id").alias("n")).select(path.alias("path"), F.concat(*(F.sha2(F.concat(F.col("n"), F.lit(f"-{k}")), 512) for k in range(10))).alias("wide"))
        got = assign_ids(fresh, spark.createDataFrame([(5,)], "id bigint"), ["path"]).select("id", "path", "wide").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert [r["id"] for r in sorted(got, key=lambda r: r["path"])] == list(range(6, 30_006))


def test_similar_vectors_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "GROUP", 30)
    monkeypatch.setattr(duplicates, "BLOCK", 8)
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4 if k % 9 else 3)]) for k in range(120)] + [(120, [0.0] * 4), (121, None), (122, [])]
    df = spark.createDataFrame(rows, "pos bigint, x array<double>")
    other = df.select(F.col("pos").alias("j"), F.col("x").alias("y"))
    value = F.round(X.cosine(F.col("x"), F.col("y")), 6).alias("similarity")
    expected = {(r["i"], r["j"]): r["similarity"] for r in df.join(other, F.col("pos") < F.col("j")).select(F.col("pos").alias("i"), "j", value).where("similarity >= 0.3").collect()}
    got = duplicates.similar_vectors(df, 0.3).collect()
    assert len(expected) > 500 and len(got) == len(expected) and {(r["i"], r["j"]): r["similarity"] for r in got} == pytest.approx(expected)


def test_vectors_without_a_number_are_no_hits(spark):
    vectors = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "photo_id bigint, embedding array<double>")
    assert [r["photo_id"] for r in search.by_vector(vectors, [1.0, 0.0], 5, 0.2).collect()] == [2]
