"""Catalogue operators bound to the test tables, each beside its SQL.

Tables that the tests lack are derived from those they have, by the same rule on both sides (``_VIEWS`` and ``Tables``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph import schema
from heliograph.catalog import assign_ids, cascade
from heliograph.functions import exprs as X
from heliograph.operators import duplicates, jobs, lookups, mutations, pipelines, relations, search
from heliograph.runtime import table
from heliograph.sources import exports
from heliograph.streaming import ingest

NOW = "2024-01-15T00:00:00"
#: Differing bits of 256 up to which photos are alike, as the catalogue's settings have it.
ALIKE = 50
DIRECTORY = "/vault/harbour"
CAMERA_ROLL = "/vault/harbour/phone-sync/Camera Uploads"

_VIEWS = {
    "face_scans": "SELECT photo_id, max(created_at) AS scanned_at, count(*) AS faces_found FROM faces GROUP BY photo_id",
    "user_tags": "SELECT id, name, '#808080' AS color, created_at FROM people",
    "photo_user_tags": "SELECT photo_id, person_id AS tag_id, min(created_at) AS created_at FROM faces WHERE person_id IS NOT NULL GROUP BY photo_id, person_id",
    "albums": "SELECT id, group_type AS name, representative_photo_id AS cover_photo_id, representative_photo_id IS NULL AS is_smart, concat('[', id % 20 + 1, ']') AS filter_tags, created_at FROM similarity_groups",
    "album_photos": "SELECT group_id AS album_id, photo_id, CAST(floor(coalesce(max(similarity_score), 0) * 10) AS INT) AS position, '2025-01-01 00:00:00' AS added_at FROM photo_similarity GROUP BY group_id, photo_id",
    "scheduled_tasks": "SELECT event_id AS id, event_type AS task_type, concat('/vault/', user_id) AS target_path, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS scheduled_at, CASE WHEN user_id % 5 > 0 THEN CAST(user_id % 24 AS INT) END AS hours_start, CAST(user_id * 7 % 24 AS INT) AS hours_end, CASE WHEN event_type IN ('click', 'view') THEN 'pending' ELSE 'completed' END AS status FROM events",
    "directory_prompts": "SELECT directory, concat('Describe ', min(filename)) AS custom_prompt FROM photos GROUP BY directory",
}


class Tables:
    """Test tables and derived tables by name."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        derived = getattr(type(self), f"_{name}", None)
        return derived(self) if derived else table(self.spark, self.root, name)

    def _face_scans(self):
        return self.faces.groupBy("photo_id").agg(F.max("created_at").alias("scanned_at"), F.count("*").alias("faces_found"))

    def _user_tags(self):
        return self.people.select("id", "name", F.lit("#808080").alias("color"), "created_at")

    def _photo_user_tags(self):
        return self.faces.where("person_id IS NOT NULL").groupBy("photo_id", F.col("person_id").alias("tag_id")).agg(F.min("created_at").alias("created_at"))

    def _albums(self):
        return self.similarity_groups.select(
            "id", F.col("group_type").alias("name"), F.col("representative_photo_id").alias("cover_photo_id"), F.col("representative_photo_id").isNull().alias("is_smart"), F.concat(F.lit("["), (F.col("id") % 20 + 1).cast("string"), F.lit("]")).alias("filter_tags"), "created_at"
        )

    def _album_photos(self):
        position = F.floor(F.coalesce(F.max("similarity_score"), F.lit(0.0)) * 10).cast("int")
        return self.photo_similarity.groupBy(F.col("group_id").alias("album_id"), "photo_id").agg(position.alias("position")).withColumn("added_at", F.lit("2025-01-01 00:00:00"))

    def _scheduled_tasks(self):
        user = F.col("user_id")
        return self.events.select(
            F.col("event_id").alias("id"), F.col("event_type").alias("task_type"), F.concat(F.lit("/vault/"), user.cast("string")).alias("target_path"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("scheduled_at"),
            F.when(user % 5 > 0, (user % 24).cast("int")).alias("hours_start"), (user * 7 % 24).cast("int").alias("hours_end"), F.when(F.col("event_type").isin("click", "view"), "pending").otherwise("completed").alias("status"),
        )

    def _directory_prompts(self):
        return self.photos.groupBy("directory").agg(F.concat(F.lit("Describe "), F.min("filename")).alias("custom_prompt"))

    def min_path(self) -> str:
        return self.photos.agg(F.min("path")).first()[0]

    def least(self, name: str, column: str):
        """The smallest value of a table's column, as a key that occurs."""
        return getattr(self, name).agg(F.min(column)).first()[0]



def _consecutive(t: Tables, value) -> DataFrame:
    """A function of each vector and the one with the next id."""
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(other, "vec_id").select("vec_id", F.round(value(F.col("embedding"), F.col("other")), 6).alias("value"))


def _appended(df: DataFrame, column: str, value) -> DataFrame:
    """(id, column) of a table and one new row above its largest id."""
    fresh = df.sparkSession.createDataFrame([(value,)], f"{column} {dict(df.dtypes)[column]}")
    return df.select("id", column).unionByName(assign_ids(fresh, df, [column]).select("id", column))


def _cascaded(t: Tables, name: str, row: int) -> dict[str, DataFrame]:
    """The tables that change when one row goes; tables that the tests lack are empty."""

    def read(table_: str) -> DataFrame:
        try:
            return getattr(t, "photo_embeddings" if table_ == "embeddings" else table_)
        except AnalysisException:
            return t.spark.createDataFrame([], schema.SCHEMAS[table_])

    return cascade(name, t.spark.createDataFrame([(row,)], "id bigint"), read)


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, root: make(Tables(spark, root))
    if sql is not None:
        used = []
        for view, body in _VIEWS.items():
            if view in sql:
                used.append(f"{view} AS ({body})")
        head = f"WITH {', '.join(used)} " if used else ""
        ORACLE_SQL[name] = head + sql if not (used and sql.startswith("WITH ")) else head + ", " + sql[5:]


def _columns(names: list[str]) -> str:
    return ", ".join(names)


R, E = _columns(lookups.RECORD), _columns(lookups.EXPORT)
FACE = _columns(relations.FACE)
BASE = "regexp_extract(path, '([^/]*)$', 1)"

# C: lookups, filters, projections
_add("c1_description", lambda t: lookups.value_of(t.photos, "path", t.min_path(), "description"), "SELECT description FROM photos WHERE path = (SELECT min(path) FROM photos)")
_add("c2_description_by_id", lambda t: lookups.value_of(t.photos, "id", 7, "description"), "SELECT description FROM photos WHERE id = 7")
_add("c3_path_by_id", lambda t: lookups.value_of(t.photos, "id", 7, "path"), "SELECT path FROM photos WHERE id = 7")
_add("c4_exists", lambda t: lookups.exists(t.photos, "path", t.min_path()), "SELECT count(*) > 0 AS found FROM photos WHERE path = (SELECT min(path) FROM photos)")
_add("c5_exists_not", lambda t: lookups.exists(t.photos, "path", "/none"), "SELECT count(*) > 0 AS found FROM photos WHERE path = '/none'")
_add("c6_mtimes", lambda t: lookups.mtimes_in_directory(t.photos, CAMERA_ROLL), f"SELECT path, modified_at FROM photos WHERE directory = '{CAMERA_ROLL}'")
_add(
    "c7_metadata",
    lambda t: lookups.metadata(t.photos, t.faces, t.people).withColumn("people", F.array_join("people", "|")),
    f"WITH seen AS (SELECT f.photo_id, count(*) AS n, string_agg(DISTINCT p.name, '|' ORDER BY p.name) AS names FROM faces f LEFT JOIN people p ON p.id = f.person_id GROUP BY 1) SELECT {_columns([f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" if c in lookups._REALS else c for c in lookups.METADATA])}, coalesce(n, 0) AS face_count, coalesce(names, '') AS people FROM photos LEFT JOIN seen ON photo_id = id",
)
_add(
    "c8_rotation", lambda t: lookups.rotations(t.photos),
    "SELECT path, CAST(((CASE coalesce(exif_orientation, 1) WHEN 6 THEN 90 WHEN 3 THEN 180 WHEN 8 THEN 270 ELSE 0 END + coalesce(user_rotation, 0)) % 360 + 360) % 360 AS INT) AS rotation FROM photos",
)
_add("c9_marked", lambda t: lookups.marked(t.photos), f"SELECT {R} FROM photos WHERE marked_for_deletion")
_add("c10_marked_not_trashed", lambda t: lookups.marked(t.photos, False), f"SELECT {R} FROM photos WHERE marked_for_deletion AND trashed_at IS NULL")
_add("c11_trashed", lambda t: lookups.trashed(t.photos), "SELECT id, path, original_path, size_bytes, trashed_at FROM photos WHERE trashed_at IS NOT NULL")
_add("c12_old_trashed", lambda t: jobs.expire_trash(t.photos, "2025-10-31T00:00:00", 30)[1], "SELECT id, path, original_path, size_bytes, trashed_at FROM photos WHERE trashed_at < '2025-10-01T00:00:00+00:00'")
_add("c13_undescribed", lambda t: lookups.undescribed(t.photos), "SELECT id, path FROM photos WHERE description IS NULL")
_add("c14_undescribed_prefix", lambda t: lookups.undescribed(t.photos, "/vault/har", "prefix"), "SELECT id, path FROM photos WHERE description IS NULL AND starts_with(path, '/vault/har')")
_add("c15_undescribed_exact", lambda t: lookups.undescribed(t.photos, CAMERA_ROLL, "exact", 50), f"SELECT id, path FROM photos WHERE description IS NULL AND directory = '{CAMERA_ROLL}' ORDER BY id LIMIT 50")
_add("c16_empty_tags", lambda t: lookups.with_empty_tags(t.photos), "SELECT id, path FROM photos WHERE llm_processed_at IS NOT NULL AND (tags IS NULL OR tags IN ('[]', ''))")
_add("c17_faces_of_photo", lambda t: t.faces.where(F.col("photo_id") == t.least("faces", "photo_id")).select(*relations.FACE), f"SELECT {FACE} FROM faces WHERE photo_id = (SELECT min(photo_id) FROM faces)")
_add("c18_faces_without_vectors", lambda t: lookups.first(t.faces, "embedding IS NULL", 100, ["id"], ["id", "photo_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h"]), "SELECT id, photo_id, bbox_x, bbox_y, bbox_w, bbox_h FROM faces WHERE embedding IS NULL ORDER BY id LIMIT 100")
_add("c19_face_vectors", lambda t: t.faces.where("embedding IS NOT NULL").select("id", F.size("embedding").alias("n")), "SELECT id, CAST(len(embedding) AS INT) AS n FROM faces WHERE embedding IS NOT NULL")
_add("c20_vector", lambda t: t.photo_embeddings.where(F.col("photo_id") == t.least("photo_embeddings", "photo_id")).select("photo_id", "embedding_dim", "model_name"), "SELECT photo_id, embedding_dim, model_name FROM photo_embeddings WHERE photo_id = (SELECT min(photo_id) FROM photo_embeddings)")
_add("c21_vectors", lambda t: t.photo_embeddings.select("photo_id", F.size("embedding").alias("n"), "model_name"), "SELECT photo_id, CAST(len(embedding) AS INT) AS n, model_name FROM photo_embeddings")
_add("c22_photos_with_tag", lambda t: t.photo_user_tags.where("tag_id = 2").select("photo_id"), "SELECT photo_id FROM photo_user_tags WHERE tag_id = 2")
_add("c23_tags", lambda t: t.user_tags.select("id", "name", "color").orderBy("name", "id"), "SELECT id, name, color FROM user_tags")
_add("c24_search_tags", lambda t: lookups.search_tags(t.user_tags, "A"), "SELECT id, name, color FROM user_tags WHERE starts_with(lower(name), 'a') ORDER BY name, id LIMIT 10")
_add("c25_album_photos", lambda t: t.album_photos.where("album_id = 4").orderBy("position", "added_at", "photo_id").select("photo_id", "position"), "SELECT photo_id, position FROM album_photos WHERE album_id = 4")
_add("c26_pending", lambda t: lookups.pending(t.scheduled_tasks).select("id", "task_type", "scheduled_at"), "SELECT id, task_type, scheduled_at FROM scheduled_tasks WHERE status = 'pending'")
_add("c27_overdue", lambda t: lookups.overdue(t.scheduled_tasks, NOW).select("id", "scheduled_at"), f"SELECT id, scheduled_at FROM scheduled_tasks WHERE status = 'pending' AND scheduled_at < '{NOW}'")
_add("c28_newest_tasks", lambda t: lookups.first(t.scheduled_tasks, "true", 100, [F.desc("scheduled_at"), "id"], ["id", "scheduled_at", "status"]), "SELECT id, scheduled_at, status FROM scheduled_tasks ORDER BY scheduled_at DESC, id LIMIT 100")
_add("c29_due", lambda t: lookups.due(t.scheduled_tasks, NOW, 10).select("id", "scheduled_at"), f"SELECT id, scheduled_at FROM scheduled_tasks WHERE status = 'pending' AND scheduled_at <= '{NOW}' ORDER BY scheduled_at, id LIMIT 10")
_add("c30_prompt", lambda t: lookups.value_of(t.directory_prompts, "directory", CAMERA_ROLL, "custom_prompt"), f"SELECT custom_prompt FROM directory_prompts WHERE directory = '{CAMERA_ROLL}'")
_add("c31_export", lambda t: lookups.export_rows(t.photos), f"SELECT {E.replace('filename', BASE + ' AS filename')} FROM photos")

# D: joins
_SEEN = f"SELECT {', '.join('f.' + c for c in relations.FACE)}, p.path, p.filename, p.taken_at FROM faces f JOIN photos p ON p.id = f.photo_id"
_add("d1_faces_of_person", lambda t: relations.faces_with_photos(t.faces, t.photos, F.col("person_id") == 1), _SEEN + " WHERE f.person_id = 1")
_add("d2_unassigned_faces", lambda t: relations.faces_with_photos(t.faces, t.photos, F.col("person_id").isNull()), _SEEN + " WHERE f.person_id IS NULL")
_add("d3_photos_of_person", lambda t: relations.photos_of_person(t.photos, t.faces, 1), "SELECT DISTINCT p.id, p.path, p.filename FROM photos p JOIN faces f ON p.id = f.photo_id WHERE f.person_id = 1")
_add("d4_unscanned_below", lambda t: relations.without(t.photos, t.face_scans, directory=DIRECTORY), f"SELECT p.id, p.path FROM photos p LEFT JOIN face_scans s ON s.photo_id = p.id WHERE s.photo_id IS NULL AND starts_with(p.path, '{DIRECTORY}/')")
_add("d5_unscanned_count", lambda t: relations.count(relations.without(t.photos, t.face_scans)), "SELECT count(*) AS n FROM photos p LEFT JOIN face_scans s ON s.photo_id = p.id WHERE s.photo_id IS NULL")
_add("d6_without_vectors", lambda t: relations.without(t.photos, t.photo_embeddings), "SELECT id, path FROM photos WHERE id NOT IN (SELECT photo_id FROM photo_embeddings)")
_add("d7_without_vectors_below", lambda t: relations.without(t.photos, t.photo_embeddings, directory=DIRECTORY), f"SELECT id, path FROM photos WHERE id NOT IN (SELECT photo_id FROM photo_embeddings) AND starts_with(path, '{DIRECTORY}/')")
_add("d8_without_faces", lambda t: relations.count(relations.without(t.photos, t.faces, directory=CAMERA_ROLL, exact=True)), f"SELECT count(*) AS n FROM photos p WHERE directory = '{CAMERA_ROLL}' AND NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id = p.id)")
_add("d9_tags_of_photo", lambda t: relations.tags_of_photo(t.user_tags, t.photo_user_tags, t.least("photo_user_tags", "photo_id")), "SELECT u.id, u.name, u.color FROM user_tags u JOIN photo_user_tags b ON b.tag_id = u.id WHERE b.photo_id = (SELECT min(photo_id) FROM photo_user_tags)")
_add("d10_album_paths", lambda t: relations.album_paths(t.photos, t.album_photos, 4), "SELECT p.path, b.position, b.added_at FROM photos p JOIN album_photos b ON b.photo_id = p.id WHERE b.album_id = 4")
_add("d11_person_by_name", lambda t: relations.people_with_counts(t.people, t.faces, name=t.least("people", "name").upper()), "SELECT p.id, p.name, count(f.id) AS face_count FROM people p LEFT JOIN faces f ON f.person_id = p.id WHERE lower(p.name) = (SELECT lower(min(name)) FROM people) GROUP BY 1, 2")
_add(
    "d13_similar_vectors",
    lambda t: duplicates.similar_vectors(t.embeddings.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("x")), 0.3),
    "SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3",
)

# E: aggregations
for _n, _t in (("e1_photos", "photos"), ("e2_faces", "faces"), ("e3_people", "people"), ("e4_vectors", "photo_embeddings")):
    _add(_n, lambda t, _t=_t: relations.count(getattr(t, _t)), f"SELECT count(*) AS n FROM {_t}")
_add("e5_faces_without_vectors", lambda t: relations.count(t.faces, "embedding IS NULL"), "SELECT count(*) AS n FROM faces WHERE embedding IS NULL")
_add("e6_trash_size", lambda t: relations.trash_size(t.photos), "SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total FROM photos WHERE trashed_at IS NOT NULL")
_PEOPLE = "SELECT p.id, p.name, count(f.id) AS face_count FROM people p LEFT JOIN faces f ON f.person_id = p.id"
_add("e7_people", lambda t: relations.people_with_counts(t.people, t.faces), _PEOPLE + " GROUP BY 1, 2")
_add("e8_person", lambda t: relations.people_with_counts(t.people, t.faces, person=2), _PEOPLE + " WHERE p.id = 2 GROUP BY 1, 2")
_add("e9_clusters", lambda t: relations.with_member_counts(t.face_clusters, t.face_cluster_members, "cluster_id", ["id", "representative_face_id", "auto_name"], "face_count"), "SELECT c.id, c.representative_face_id, c.auto_name, count(m.face_id) AS face_count FROM face_clusters c LEFT JOIN face_cluster_members m ON m.cluster_id = c.id GROUP BY 1, 2, 3")
_add("e10_albums", lambda t: relations.with_member_counts(t.albums, t.album_photos, "album_id", ["id", "name", "is_smart"], "photo_count"), "SELECT id, name, is_smart, (SELECT count(*) FROM album_photos b WHERE b.album_id = a.id) AS photo_count FROM albums a")
_EXACT = "m AS (SELECT *, row_number() OVER (PARTITION BY sha256_hash ORDER BY taken_at NULLS FIRST, path) AS pos, count(*) OVER (PARTITION BY sha256_hash) AS n FROM photos WHERE sha256_hash IS NOT NULL), g AS (SELECT * FROM m WHERE n > 1)"
_add("e11_exact_duplicates", lambda t: duplicates.exact_groups(t.photos).select("sha256_hash", "id", "pos"), f"WITH {_EXACT} SELECT sha256_hash, id, CAST(pos AS INT) AS pos FROM g")
_add("e12_smart_album", lambda t: relations.smart_album(t.photo_user_tags, [t.least("photo_user_tags", "tag_id")]), "SELECT photo_id FROM photo_user_tags WHERE tag_id = (SELECT min(tag_id) FROM photo_user_tags)")
_add("e12_smart_albums", lambda t: relations.smart_albums(t.albums, t.photo_user_tags), "SELECT a.id AS album_id, b.photo_id FROM albums a JOIN photo_user_tags b ON b.tag_id = CAST(trim(a.filter_tags, '[]') AS BIGINT) WHERE a.is_smart")
_add("e13_by_camera", lambda t: relations.by_camera(t.photos), "SELECT camera_make, camera_model, count(*) AS n FROM photos WHERE camera_model IS NOT NULL GROUP BY 1, 2")
_add("e13_largest_directories", lambda t: relations.largest_directories(t.photos), "SELECT directory, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM photos GROUP BY 1 ORDER BY 3 DESC NULLS LAST, 1 LIMIT 10")
_add("e13_latest_scanned", lambda t: lookups.first(t.photos, "true", 20, [F.desc("scanned_at"), "id"], ["id", "path", "scanned_at"]), "SELECT id, path, scanned_at FROM photos ORDER BY scanned_at DESC, id LIMIT 20")
_add("e13_duplicate_paths", lambda t: duplicates.exact_groups(t.photos).groupBy("sha256_hash").agg(F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths")), f"WITH {_EXACT} SELECT sha256_hash, string_agg(path, '|' ORDER BY path) AS paths FROM g GROUP BY 1")
_add("e13_described_like", lambda t: t.photos.where(F.lower("description").like("%bridge%light%")).select("id"), "SELECT id FROM photos WHERE lower(description) LIKE '%bridge%light%'")
_SCORE = "coalesce(CAST(width AS BIGINT) * CAST(height AS BIGINT) // 10000, 0) + coalesce(size_bytes, 0) // 100000 + CASE WHEN taken_at IS NULL THEN 0 ELSE 10 END"

# F: similarity, search, scoring
_add(
    "f4_vector_search",
    lambda t: search.by_vector(t.embeddings, t.embeddings.where("vec_id = 0").first()["embedding"], 20, -1.0, "vec_id"),
    "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20",
)
_add(
    "f5_word_search",
    lambda t: search.by_words(t.photos, "bridge Light bridge view", 20),
    "SELECT id, (2 * CAST(contains(lower(description), 'bridge') AS INT) + CAST(contains(lower(description), 'light') AS INT) + CAST(contains(lower(description), 'view') AS INT)) / 4 AS similarity FROM photos WHERE description IS NOT NULL AND similarity > 0 ORDER BY similarity DESC, id LIMIT 20",
)


# stand-ins for the models of the cascade: one finds nothing like any text, the other takes a text for a stored vector
def _knows_nothing(text: str) -> list[float]:
    return [0.0] * 128


def _stored(t: Tables):
    return lambda text: t.photo_embeddings.where("size(embedding) = 128").orderBy("photo_id").first()["embedding"]


def _nearest(least: float) -> str:
    return f"WITH v AS MATERIALIZED (SELECT photo_id, embedding::DOUBLE[] AS e FROM photo_embeddings WHERE len(embedding) = 128), q AS (SELECT e AS one FROM v ORDER BY photo_id LIMIT 1), s AS (SELECT photo_id, round(list_cosine_similarity(e, one), 6) AS similarity FROM v, q), h AS (SELECT * FROM s WHERE similarity >= {least} AND NOT isnan(similarity) ORDER BY similarity DESC, photo_id LIMIT 20) SELECT photo_id, similarity, path, filename FROM h JOIN photos ON id = photo_id"


_add("f4_photo_search", lambda t: search.with_photos(search.by_vector(t.photo_embeddings.where("size(embedding) = 128"), t.photo_embeddings.where("size(embedding) = 128").orderBy("photo_id").first()["embedding"], 20, 0.2), t.photos), _nearest(0.2))
_add("f6_cascade_image", lambda t: search.cascade(t.photo_embeddings, t.photos, "bridge", _stored(t), _knows_nothing), _nearest(0.2))
_add("f6_cascade_provider", lambda t: search.cascade(t.photo_embeddings, t.photos, "bridge", _knows_nothing, _stored(t)), _nearest(0.3))
_add("f6_cascade", lambda t: search.cascade(t.photo_embeddings, t.photos, "bridge", _knows_nothing, _knows_nothing), "SELECT id AS photo_id, 1.0::DOUBLE AS similarity, path, filename FROM photos WHERE contains(lower(description), 'bridge') ORDER BY id LIMIT 20")
# hashes as upper-case hexadecimal text, null where they do not give 256 bits, and their words
_BLANK = "regexp_replace(perceptual_hash, '\\s+', '', 'g')"
_BITS = f"CASE WHEN regexp_full_match({_BLANK}, '[0-9A-Fa-f]{{64}}') THEN upper({_BLANK}) WHEN regexp_full_match({_BLANK}, '[A-Za-z0-9+/_-]{{43}}=?') THEN hex(from_base64(replace(translate({_BLANK}, '-_', '+/'), '=', '') || '=')) END"
_APART = " + ".join(f"bit_count(xor(a.q[{k}], b.q[{k}]))::INT" for k in range(1, 5))
_HASHED = f"h AS (SELECT id, path, {_BITS} AS bits FROM photos), p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY path) AS i, id, bits, list_transform(range(4), lambda k: CAST('0x' || substr(bits, 16 * k + 1, 16) AS UBIGINT)) AS q FROM h WHERE bits IS NOT NULL)"
_LEADERS = f"""{_HASHED}, n AS MATERIALIZED (SELECT a.i, a.id, coalesce(list(b.i ORDER BY b.i) FILTER (b.i IS NOT NULL), []) AS nb FROM p a LEFT JOIN p b ON b.i < a.i AND {_APART} <= {ALIKE} GROUP BY a.i, a.id),
 st(i, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.i, CASE WHEN len(n.nb) = 0 OR len(list_intersect(n.nb, st.leaders)) = 0 THEN list_append(st.leaders, n.i) ELSE st.leaders END FROM st JOIN n ON n.i = st.i + 1),
 z AS (SELECT leaders FROM st ORDER BY i DESC LIMIT 1), led AS (SELECT n.id, CASE WHEN list_contains(leaders, n.i) THEN n.i ELSE list_min(list_intersect(nb, leaders)) END AS leader FROM n, z),
 gr AS (SELECT led.id, p.id AS group_id, count(*) OVER (PARTITION BY leader) AS c FROM led JOIN p ON p.i = led.leader)"""
_add("f7_perceptual_groups", lambda t: duplicates.perceptual_groups(t.photos, ALIKE).select("group_id", "id"), f"WITH RECURSIVE {_LEADERS} SELECT group_id, id FROM gr WHERE c > 1")
_add("f8_duplicate_report", lambda t: duplicates.exact_groups(t.photos).select("group_type", "id").unionByName(duplicates.perceptual_groups(t.photos, ALIKE).select("group_type", "id")), f"WITH RECURSIVE {_LEADERS}, {_EXACT} SELECT 'exact' AS group_type, id FROM g UNION ALL SELECT 'perceptual', id FROM gr WHERE c > 1")
_add("f9_scores", lambda t: t.photos.select("id", X.quality_score(F.col("width"), F.col("height"), F.col("size_bytes"), F.col("taken_at")).alias("score")), f"SELECT id, CAST(floor(coalesce(CAST(width AS DOUBLE) * height / 10000, 0)) + floor(coalesce(size_bytes, 0) / 100000) + CASE WHEN taken_at IS NULL THEN 0 ELSE 10 END AS BIGINT) AS score FROM photos")
_FLOOR = "CAST(floor(coalesce(CAST(width AS DOUBLE) * height / 10000, 0)) + floor(coalesce(size_bytes, 0) / 100000) + CASE WHEN taken_at IS NULL THEN 0 ELSE 10 END AS BIGINT)"
_add("f10_keep_best", lambda t: duplicates.keep_best(duplicates.exact_groups(t.photos), "sha256_hash").select("sha256_hash", "id", "score", "delete"), f"WITH {_EXACT} SELECT sha256_hash, id, {_FLOOR} AS score, row_number() OVER (PARTITION BY sha256_hash ORDER BY {_FLOOR} DESC, pos) > 1 OR coalesce(marked_for_deletion, false) AS delete FROM g")
_STEM = "regexp_replace(lower(filename), '(.)\\.[^.]*$', '\\1')"
_COPY = f"(regexp_matches(regexp_extract({_STEM}, '.*( \\(.*)$', 1), '^ \\([0-9]+\\)') OR regexp_matches({_STEM}, '[_-][0-9]+$') OR " + " OR ".join(f"contains(lower(filename), '{w}')" for w in X.COPY_WORDS) + ")"
_add("f11_copy_suffix", lambda t: t.photos.select("id", X.copy_suffix(F.col("filename")).alias("is_copy")), f"SELECT id, {_COPY} AS is_copy FROM photos")
_NAME = f"CASE WHEN {_COPY} THEN 1000 ELSE 0 END + octet_length(encode(path))"
_add("f12_name_score", lambda t: t.photos.select("id", X.filename_score(F.col("path"), F.col("filename")).alias("score")), f"SELECT id, CAST({_NAME} AS BIGINT) AS score FROM photos")
_add("f13_mark_identical", lambda t: duplicates.mark_identical(duplicates.exact_groups(t.photos), "sha256_hash").select("id", "score"), f"WITH {_EXACT}, s AS (SELECT id, CAST({_NAME} AS BIGINT) AS score, marked_for_deletion, row_number() OVER (PARTITION BY sha256_hash ORDER BY {_NAME}, pos) AS r FROM g) SELECT id, score FROM s WHERE r > 1 AND NOT coalesce(marked_for_deletion, false)")
_add("f14_remove_members", lambda t: duplicates.remove_members(duplicates.exact_groups(t.photos), "sha256_hash", t.photos.where("marked_for_deletion")).select("sha256_hash", "id"), f"WITH {_EXACT}, l AS (SELECT *, count(*) OVER (PARTITION BY sha256_hash) AS k FROM g WHERE NOT coalesce(marked_for_deletion, false)) SELECT sha256_hash, id FROM l WHERE k >= 2")


def _face_leaders(t: Tables) -> DataFrame:
    x = t.embeddings.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("x"))
    return duplicates.leaders(x.select("pos"), duplicates.similar_vectors(x, 0.3))


_add(
    "f15_leader_clusters", _face_leaders,
    """WITH RECURSIVE p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 g AS MATERIALIZED (SELECT a.i, a.vec_id, coalesce(list(b.vec_id ORDER BY b.vec_id) FILTER (b.i IS NOT NULL), []) AS nb FROM p a LEFT JOIN p b ON b.i < a.i AND round(list_cosine_similarity(a.e, b.e), 6) >= 0.3 GROUP BY a.i, a.vec_id),
 st(i, leaders) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT g.i, CASE WHEN len(list_intersect(g.nb, st.leaders)) = 0 THEN list_append(st.leaders, g.vec_id) ELSE st.leaders END FROM st JOIN g ON g.i = st.i + 1),
 l AS (SELECT leaders FROM st ORDER BY i DESC LIMIT 1)
 SELECT vec_id AS pos, CASE WHEN list_contains(leaders, vec_id) THEN vec_id ELSE list_min(list_intersect(nb, leaders)) END AS leader FROM g, l""",
)
_add("f16_merge_clusters", lambda t: mutations.merge_clusters(t.faces, t.face_cluster_members, [1, 2, 3], 1).select("id", "person_id"), "SELECT id, CASE WHEN person_id IS NULL AND id IN (SELECT face_id FROM face_cluster_members WHERE cluster_id IN (1, 2, 3)) THEN 1 ELSE person_id END AS person_id FROM faces")
_add("f18_suppress_boxes", lambda t: duplicates.box_leaders(t.faces.select("id", "photo_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "confidence"), 0.3), """WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC NULLS LAST, id) AS r FROM faces),
 n AS MATERIALIZED (SELECT a.photo_id, a.id, a.r, coalesce(list(b.r) FILTER (b.r IS NOT NULL), []) AS nb FROM o a LEFT JOIN o b ON a.photo_id = b.photo_id AND b.r < a.r AND ({i}) > 0.3 * (a.bbox_w * a.bbox_h + b.bbox_w * b.bbox_h - ({i})) AND a.bbox_w * a.bbox_h + b.bbox_w * b.bbox_h - ({i}) > 0 GROUP BY ALL),
 st(photo_id, r, kept, id, keep) AS (SELECT photo_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, false FROM o GROUP BY 1 UNION ALL SELECT n.photo_id, n.r, CASE WHEN len(list_intersect(n.nb, st.kept)) = 0 THEN list_append(st.kept, n.r) ELSE st.kept END, n.id, len(list_intersect(n.nb, st.kept)) = 0 FROM st JOIN n ON n.photo_id = st.photo_id AND n.r = st.r + 1)
 SELECT photo_id, id FROM st WHERE keep""".format(i="greatest(0, least(a.bbox_x + a.bbox_w, b.bbox_x + b.bbox_w) - greatest(a.bbox_x, b.bbox_x)) * greatest(0, least(a.bbox_y + a.bbox_h, b.bbox_y + b.bbox_h) - greatest(a.bbox_y, b.bbox_y))"))
_BOX = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]


def _overlaps(t: Tables) -> DataFrame:
    a = t.faces.select("photo_id", F.col("id").alias("i"), *(F.col(c).alias(f"a_{c}") for c in _BOX))
    b = t.faces.select("photo_id", F.col("id").alias("j"), *(F.col(c).alias(f"b_{c}") for c in _BOX))
    value = X.iou([F.col(f"a_{c}") for c in _BOX], [F.col(f"b_{c}") for c in _BOX])
    return a.join(b, "photo_id").where("i < j").select("i", "j", F.round(value, 6).alias("overlap")).where("overlap > 0")


_INTER = "greatest(0, least(a.bbox_x + a.bbox_w, b.bbox_x + b.bbox_w) - greatest(a.bbox_x, b.bbox_x)) * greatest(0, least(a.bbox_y + a.bbox_h, b.bbox_y + b.bbox_h) - greatest(a.bbox_y, b.bbox_y))"
_add("f19_overlaps", _overlaps, f"SELECT a.id AS i, b.id AS j, round({_INTER} / (a.bbox_w * a.bbox_h + b.bbox_w * b.bbox_h - {_INTER})::DOUBLE, 6) AS overlap FROM faces a JOIN faces b ON a.photo_id = b.photo_id AND a.id < b.id WHERE overlap > 0")
_add("f22_unit_vectors", lambda t: t.embeddings.select("vec_id", F.round(X.norm(X.unit(F.col("embedding"))), 6).alias("norm")), "SELECT vec_id, 1.0::DOUBLE AS norm FROM embeddings")
_add("f23_content_hashes", lambda t: t.documents.where("text IS NOT NULL").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha")), "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
_add("f26_hashed_photos", lambda t: t.photos.where("perceptual_hash IS NOT NULL").select(*lookups.RECORD), f"SELECT {R} FROM photos WHERE perceptual_hash IS NOT NULL")

# G: changes
_add("g3_insert_ignore", lambda t: mutations.insert_ignore(t.photos.select("path", "size_bytes"), t.incoming_photos.select("path", "size_bytes").groupBy("path").agg(F.max("size_bytes").alias("size_bytes")), ["path"]), "SELECT path, size_bytes FROM photos UNION ALL SELECT path, max(size_bytes) FROM incoming_photos WHERE path NOT IN (SELECT path FROM photos) GROUP BY path")
_add("g6_save_result", lambda t: mutations.save_result(t.photos, 7, "text", '["a"]', NOW).select("id", "description", "tags", "llm_processed_at"), f"SELECT id, CASE WHEN id = 7 THEN 'text' ELSE description END AS description, CASE WHEN id = 7 THEN '[\"a\"]' ELSE tags END AS tags, CASE WHEN id = 7 THEN '{NOW}' ELSE llm_processed_at END AS llm_processed_at FROM photos")
_add("g8_clear_result", lambda t: mutations.clear_result(t.photos, 7).select("id", "description", "tags"), "SELECT id, CASE WHEN id <> 7 THEN description END AS description, CASE WHEN id <> 7 THEN tags END AS tags FROM photos")
_add("g9_move_path", lambda t: mutations.move_path(t.photos, t.min_path(), "/new/x.jpg").select("id", "path", "filename"), "SELECT id, CASE WHEN path = (SELECT min(path) FROM photos) THEN '/new/x.jpg' ELSE path END AS path, filename FROM photos")
_add("g12_rotate", lambda t: mutations.rotate(t.photos, t.min_path(), 270).select("id", "user_rotation"), "SELECT id, CAST(CASE WHEN path = (SELECT min(path) FROM photos) THEN (coalesce(user_rotation, 0) + 270) % 360 ELSE user_rotation END AS INT) AS user_rotation FROM photos")
_add("g14_mark", lambda t: mutations.mark(t.photos, [1, 2, 3]).select("id", "marked_for_deletion"), "SELECT id, CASE WHEN id IN (1, 2, 3) THEN true ELSE marked_for_deletion END AS marked_for_deletion FROM photos")
_add("g16_delete_marked", lambda t: mutations.delete(t.photos, F.col("marked_for_deletion")).select("id"), "SELECT id FROM photos WHERE NOT coalesce(marked_for_deletion, false)")
_add("g17_delete_ids", lambda t: mutations.delete_ids(t.photos, [1, 2, 3]).select("id"), "SELECT id FROM photos WHERE id NOT IN (1, 2, 3)")
_add("g18_to_trash", lambda t: mutations.move_to_trash(t.photos, 4, "/trash/4", NOW).select("id", "path", "original_path", "trashed_at", "marked_for_deletion"), f"SELECT id, CASE WHEN id = 4 THEN '/trash/4' ELSE path END AS path, CASE WHEN id = 4 THEN path ELSE original_path END AS original_path, CASE WHEN id = 4 THEN '{NOW}' ELSE trashed_at END AS trashed_at, CASE WHEN id = 4 THEN false ELSE marked_for_deletion END AS marked_for_deletion FROM photos")
_add("g22_find_or_create", lambda t: mutations.find_or_create(t.people, t.people.select(F.upper("name").alias("name")).unionByName(t.people.select(F.concat("name", F.lit(" jr")).alias("name"))), NOW).groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("n")), "SELECT low, count(*) AS n FROM (SELECT lower(name) AS low FROM people UNION ALL (SELECT lower(name) || ' jr' AS low FROM people WHERE lower(name) || ' jr' NOT IN (SELECT lower(name) FROM people) GROUP BY 1)) GROUP BY 1")
_add("g33_cluster_to_person", lambda t: mutations.cluster_to_person(t.faces, t.face_cluster_members, 1, 2).select("id", "person_id"), "SELECT id, CASE WHEN id IN (SELECT face_id FROM face_cluster_members WHERE cluster_id = 1) THEN 2 ELSE person_id END AS person_id FROM faces")
_add("g34_upsert", lambda t: mutations.upsert(t.photo_embeddings.select("photo_id", "model_name"), t.photos.where("is_favorite").select(F.col("id").alias("photo_id"), F.lit("new").alias("model_name")), ["photo_id"]), "SELECT photo_id, model_name FROM photo_embeddings WHERE photo_id NOT IN (SELECT id FROM photos WHERE is_favorite) UNION ALL SELECT id, 'new' FROM photos WHERE is_favorite")
_add("g36_set_status", lambda t: mutations.set_status(t.scheduled_tasks.withColumns({"started_at": F.lit(None).cast("string")}), 5, "running", NOW).select("id", "status", "started_at"), f"SELECT id, CASE WHEN id = 5 THEN 'running' ELSE status END AS status, CASE WHEN id = 5 THEN '{NOW}' END AS started_at FROM scheduled_tasks")
_add("g47_tag_photo", lambda t: mutations.insert_ignore(t.photo_user_tags.select("photo_id", "tag_id"), t.photos.where("is_favorite").select(F.col("id").alias("photo_id"), F.lit(1).cast("bigint").alias("tag_id")), ["photo_id", "tag_id"]), "SELECT photo_id, tag_id FROM photo_user_tags UNION SELECT id, 1 FROM photos WHERE is_favorite")
_add("g53_filter_tags", lambda t: mutations.set_filter_tags(t.albums, 3, [4, 5]).select("id", "filter_tags", "is_smart"), "SELECT id, CASE WHEN id = 3 THEN '[4,5]' ELSE filter_tags END AS filter_tags, id = 3 OR is_smart AS is_smart FROM albums")

# H: pipelines
_add(
    "h5_changes",
    lambda t: pipelines.detect_changes(t.incoming_photos.groupBy("path").agg(F.lit("2026-01-01 00:00:00").cast("timestamp").alias("mtime")).unionByName(t.photos.select("path", F.lit("2019-01-01 00:00:00").cast("timestamp").alias("mtime"))), t.photos),
    "WITH l AS (SELECT DISTINCT path, TIMESTAMP '2026-01-01' AS mtime FROM incoming_photos UNION ALL SELECT path, TIMESTAMP '2019-01-01' FROM photos), j AS (SELECT l.path, l.mtime, p.id, CASE WHEN regexp_full_match(p.modified_at, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}') THEN try_cast(p.modified_at AS TIMESTAMP) END AS db FROM l LEFT JOIN photos p ON p.path = l.path) SELECT path, CASE WHEN id IS NULL THEN 'new' ELSE 'modified' END AS change FROM j WHERE id IS NULL OR db IS NULL OR epoch(mtime) - epoch(db) > 2",
)
_add("h1_scan_actions", lambda t: pipelines.scan_actions(t.incoming_photos, t.photos).groupBy("action").agg(F.count("*").alias("n")), "SELECT CASE WHEN path IN (SELECT path FROM photos) THEN 'update' ELSE 'insert' END AS action, count(*) AS n FROM incoming_photos GROUP BY 1")


def _trash(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").cast("string").alias("path"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime_s"), F.floor("o_totalprice").cast("bigint").alias("size"))


_NOW_S, _AGE_S, _BYTES = 904_608_000, 86_400 * 1000, 300_000_000
_RETAIN = f"WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(epoch(o_orderdate) AS BIGINT) AS mtime_s, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders), k AS (SELECT *, sum(size) OVER () - coalesce(sum(size) OVER (ORDER BY mtime_s, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM f WHERE NOT mtime_s < {_NOW_S - _AGE_S}), d AS (SELECT path, mtime_s, size, 'age' AS reason FROM f WHERE mtime_s < {_NOW_S - _AGE_S} UNION ALL SELECT path, mtime_s, size, 'size' FROM k WHERE rest > {_BYTES})"
_add("h7_retention", lambda t: pipelines.retention(_trash(t), _NOW_S, _AGE_S, _BYTES), _RETAIN + " SELECT * FROM d")
_add("e14_cleanup_totals", lambda t: pipelines.cleanup_totals(pipelines.retention(_trash(t), _NOW_S, _AGE_S, _BYTES)), _RETAIN + " SELECT count(*) AS files_deleted, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_freed FROM d")
_add("h10_runnable", lambda t: lookups.runnable(t.scheduled_tasks, NOW, 13).select("id"), f"SELECT id FROM scheduled_tasks WHERE status = 'pending' AND scheduled_at <= '{NOW}' AND (hours_start IS NULL OR hours_end IS NULL OR CASE WHEN hours_start <= hours_end THEN 13 >= hours_start AND 13 < hours_end ELSE 13 >= hours_start OR 13 < hours_end END)")

# I, J, L: names, display, replies
_SANE = lambda c: f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_add("i1_sanitise", lambda t: t.photos.select("id", X.sanitise(F.col("filename")).alias("clean")), f"SELECT id, {_SANE('filename')} AS clean FROM photos")
_CHAIN = lambda c: "CASE " + " ".join(f"WHEN contains(lower({c}), '{w}') THEN '{w}'" for w in X.EVENT_WORDS) + " END"
_add("i2_event", lambda t: t.photos.select("id", X.event(F.col("tags"), F.col("description")).alias("event")), f"SELECT id, coalesce({_CHAIN('tags')}, {_CHAIN('description')}) AS event FROM photos")
_add("i3_brief", lambda t: t.photos.select("id", X.brief(F.col("description")).alias("brief")), f"SELECT id, nullif({_SANE(chr(97) + '')}, '') AS brief FROM (SELECT id, array_to_string(list_filter(regexp_split_to_array(split_part(description, '.', 1), '\\s+'), lambda x: x <> '')[1:4], ' ') AS a FROM photos)")
_add("i6_folder", lambda t: t.photos.select("id", X.destination_folder(F.lit("/library"), F.col("taken_at")).alias("folder")), "SELECT id, concat('/library/', CASE WHEN try_strptime(taken_at, ['%Y-%m-%d %H:%M:%S', '%Y:%m:%d %H:%M:%S']) IS NOT NULL AND regexp_full_match(taken_at, '\\d{4}[-:]\\d{2}[-:]\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN strftime(try_strptime(taken_at, ['%Y-%m-%d %H:%M:%S', '%Y:%m:%d %H:%M:%S']), '%Y/%m') ELSE 'unknown' END) AS folder FROM photos")
_add("j2_suggest_tags", lambda t: lookups.suggest_tags(t.user_tags, t.least("user_tags", "name").strip()[:2].upper()), "SELECT id, name FROM user_tags WHERE contains(lower(name), lower(substr(trim((SELECT min(name) FROM user_tags)), 1, 2)))")
_add("j3_rename", lambda t: pipelines.rename_plan(t.photos.select("path", "filename", F.lit(1_000_000_000).alias("mtime_s")), "{date}_{counter}_{name}.{ext}"), "SELECT path, '20010920_' || printf('%03d', row_number() OVER (ORDER BY path)) || '_' || regexp_replace(filename, '(.)\\.[^.]*$', '\\1') || '.' || lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS new_name FROM photos")
_add("j4_rename_conflicts", lambda t: pipelines.rename_conflicts(t.photos.select(F.lower("filename").alias("new_name")), t.photos), "SELECT lower(filename) AS new_name, 'duplicate' AS kind FROM photos GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT lower(filename), 'exists' FROM photos WHERE lower(filename) IN (SELECT filename FROM photos)")
_add("j5_sizes", lambda t: t.photos.select("id", X.size_text(F.col("size_bytes")).alias("size")), "SELECT id, CASE WHEN size_bytes >= 1073741824 THEN printf('%.1f GB', size_bytes / 1073741824.0) WHEN size_bytes >= 1048576 THEN printf('%.1f MB', size_bytes / 1048576.0) WHEN size_bytes >= 1024 THEN printf('%.1f KB', size_bytes / 1024.0) ELSE CAST(size_bytes AS VARCHAR) || ' bytes' END AS size FROM photos")
_ESC = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_add("j6_escape", lambda t: t.documents.select("doc_id", X.html_escape(F.col("text")).alias("safe")), f"SELECT doc_id, {_ESC('text')} AS safe FROM documents")
_add("j7_camera_line", lambda t: t.photos.select("id", X.camera_line(F.col("aperture"), F.col("shutter_speed"), F.col("iso"), F.col("focal_length")).alias("line")), "SELECT id, concat_ws(' | ', CASE WHEN aperture IS NOT NULL THEN printf('f/%.1f', aperture) END, shutter_speed || 's', 'ISO ' || iso, CASE WHEN focal_length IS NOT NULL THEN printf('%.0fmm', focal_length) END) AS line FROM photos")
_add("j9_images", lambda t: relations.count(t.photos, X.extension(F.col("path")).isin(X.IMAGE_EXTENSIONS)), "SELECT count(*) AS n FROM photos WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN (" + ", ".join(f"'{e}'" for e in X.IMAGE_EXTENSIONS) + ")")
_add("l1_replies", lambda t: pipelines.parse_reply(t.photos.select("id", F.concat(F.coalesce("description", F.lit("none")), F.lit("\nTags: A, *b*")).alias("text"))).select("id", "reply_description", F.array_join("reply_tags", "|").alias("tags")), "SELECT id, trim(coalesce(description, 'none'), ' ') AS reply_description, 'a|b' AS tags FROM photos")
_HTML_LINE = lambda label, c: f"coalesce('<p>{label}: ' || {_ESC(c)} || '</p>', '')"
_HTML_SIZE = "CASE WHEN size_bytes >= 1073741824 THEN printf('%.1f GB', size_bytes / 1073741824.0) WHEN size_bytes >= 1048576 THEN printf('%.1f MB', size_bytes / 1048576.0) WHEN size_bytes >= 1024 THEN printf('%.1f KB', size_bytes / 1024.0) ELSE CAST(size_bytes AS VARCHAR) || ' bytes' END"
_add(
    "b4_html", lambda t: exports.html_rows(t.photos),
    f"SELECT path, '<div class=\"card\"><h2>' || {_ESC(BASE)} || '</h2>' || " + " || ".join(_HTML_LINE(label, c) for label, c in (("Path", "path"), ("Size", f"({_HTML_SIZE})"), ("Taken", "taken_at"), ("Camera", "concat_ws(' ', camera_make, camera_model)"), ("Description", "description"), ("Tags", "tags"))) + " || '</div>' AS value FROM photos",
)
_add("s1_event_windows", lambda t: ingest.event_windows(t.events).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total")), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
_add("k_json_props", lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")

# further lookups and scores
_add("c7_people_of_photo", lambda t: t.faces.where(F.col("photo_id") == t.least("photo_user_tags", "photo_id")).join(t.people.select(F.col("id").alias("person_id"), "name"), "person_id").select("name").distinct(), "SELECT DISTINCT p.name FROM faces f JOIN people p ON p.id = f.person_id WHERE f.photo_id = (SELECT min(photo_id) FROM faces WHERE person_id IS NOT NULL)")
_add("f1_cosines", lambda t: _consecutive(t, X.cosine), "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
_add("f2_distances", lambda t: _consecutive(t, X.euclidean), "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
_add("f3_matches", lambda t: _consecutive(t, X.cosine).where("value > 0.1").select("vec_id"), "SELECT a.vec_id FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) > 0.1")
_add("f17_missing_vectors", lambda t: lookups.first(t.faces, "embedding IS NULL", 10_000, ["id"], ["id", "photo_id"]), "SELECT id, photo_id FROM faces WHERE embedding IS NULL ORDER BY id LIMIT 10000")
_add("f20_clipped_boxes", lambda t: t.faces.where("confidence > 0.7").select("id", *(F.greatest(f"bbox_{c}", F.lit(least)).alias(c) for c, least in (("x", 0), ("y", 0), ("w", 1), ("h", 1)))), "SELECT id, greatest(bbox_x, 0) AS x, greatest(bbox_y, 0) AS y, greatest(bbox_w, 1) AS w, greatest(bbox_h, 1) AS h FROM faces WHERE confidence > 0.7")
_add("f21_padded_boxes", lambda t: t.faces.join(t.photos.select(F.col("id").alias("photo_id"), "width"), "photo_id").select("id", X.padded("bbox_x", "bbox_w", F.col("width"))[0].alias("x"), X.padded("bbox_x", "bbox_w", F.col("width"))[1].alias("w")), "SELECT f.id, greatest(0, bbox_x - bbox_w // 5) AS x, least(bbox_w + 2 * (bbox_w // 5), width - greatest(0, bbox_x - bbox_w // 5)) AS w FROM faces f JOIN photos p ON p.id = f.photo_id")
_add("f25_one_group", lambda t: duplicates.exact_groups(t.photos.where(F.col("sha256_hash") == t.photos.groupBy("sha256_hash").count().where("sha256_hash IS NOT NULL AND count > 1").agg(F.min("sha256_hash")).first()[0])).select("id", "pos"), "WITH h AS (SELECT min(sha256_hash) AS s FROM (SELECT sha256_hash FROM photos GROUP BY 1 HAVING count(*) > 1 AND sha256_hash IS NOT NULL)) SELECT id, CAST(row_number() OVER (ORDER BY taken_at NULLS FIRST, path) AS INT) AS pos FROM photos, h WHERE sha256_hash = s")
_add("f27_hit", lambda t: t.photos.where("id = 5").select("id", "path", "filename", F.lit(0.5).alias("similarity")), "SELECT id, path, filename, 0.5::DOUBLE AS similarity FROM photos WHERE id = 5")
_add("d12_similar_hashes", lambda t: duplicates.hamming_edges(t.photos.select(F.col("id").alias("pos"), duplicates.H.perceptual_bits(F.col("perceptual_hash")).alias("bits")).where("bits IS NOT NULL"), ALIKE), f"WITH {_HASHED} SELECT a.id AS i, b.id AS j, {_APART} AS distance FROM p a JOIN p b ON a.id < b.id WHERE {_APART} <= {ALIKE} AND a.bits <> repeat('0', 64) AND b.bits <> repeat('0', 64)")
_add("d14_query_vector", lambda t: search.by_vector(t.embeddings, [1.0] + [0.0] * 63, 10, -1.0, "vec_id"), "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], [1.0] || list_transform(range(63), lambda x: 0.0)), 6) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
_add("d15_listing_join", lambda t: t.incoming_photos.select("path").distinct().join(t.photos.select("path", "modified_at"), "path", "left"), "SELECT DISTINCT i.path, p.modified_at FROM incoming_photos i LEFT JOIN photos p ON p.path = i.path")
_add("e15_scan_summary", lambda t: pipelines.scan_actions(t.photos.select("path"), t.photos.where("width IS NOT NULL")).groupBy("action").agg(F.count("*").alias("n")), "SELECT CASE WHEN width IS NULL THEN 'insert' ELSE 'update' END AS action, count(*) AS n FROM photos GROUP BY 1")
_add("e16_change_totals", lambda t: pipelines.detect_changes(t.photos.select("path", F.lit("2019-01-01 00:00:00").cast("timestamp").alias("mtime")), t.photos.where("is_favorite")).groupBy("change").agg(F.count("*").alias("n")), "WITH j AS (SELECT is_favorite AS fav, CASE WHEN regexp_full_match(modified_at, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}') THEN try_cast(modified_at AS TIMESTAMP) END AS db FROM photos) SELECT CASE WHEN NOT coalesce(fav, false) THEN 'new' ELSE 'modified' END AS change, count(*) AS n FROM j WHERE NOT coalesce(fav, false) OR db IS NULL OR epoch(TIMESTAMP '2019-01-01') - epoch(db) > 2 GROUP BY 1")

# further changes
_set = lambda c, k, v: f"CASE WHEN id = {k} THEN {v} ELSE {c} END AS {c}"
_add("g1_insert_scanned", lambda t: mutations.insert_new(t.photos.select("id", "path"), t.incoming_photos.select("path").distinct(), ["path"], ["path"]), "SELECT id, path FROM photos UNION ALL SELECT (SELECT max(id) FROM photos) + row_number() OVER (ORDER BY path), path FROM (SELECT DISTINCT path FROM incoming_photos WHERE path NOT IN (SELECT path FROM photos))")
_add("g2_update_scanned", lambda t: mutations.update_from(t.photos.select("id", "width", "height"), t.photos.where("width IS NULL").select("id", F.lit(1).alias("width"), F.lit(2).alias("height")), "id"), "SELECT id, coalesce(width, 1) AS width, CASE WHEN width IS NULL THEN 2 ELSE height END AS height FROM photos")
_add("g4_ensure_photo", lambda t: mutations.insert_new(t.photos.select("id", "path"), t.spark.createDataFrame([("/new/a.jpg",)], "path string"), ["path"], ["path"]).agg(F.count("*").alias("n"), F.max("id").alias("top")), "SELECT count(*) + 1 AS n, max(id) + 1 AS top FROM photos")
_add("g5_save_description", lambda t: mutations.save_description(t.photos, t.min_path(), "new", NOW).select("id", "description"), "SELECT id, CASE WHEN path = (SELECT min(path) FROM photos) THEN 'new' ELSE description END AS description FROM photos")
_add("g7_description_by_id", lambda t: mutations.update(t.photos, F.col("id") == 7, {"description": F.lit("x")}).select("id", "description"), f"SELECT id, {_set('description', 7, chr(39) + 'x' + chr(39))} FROM photos")
_add("g10_set_rotation", lambda t: mutations.set_rotation(t.photos, t.min_path(), -90).select("id", "user_rotation"), "SELECT id, CAST(CASE WHEN path = (SELECT min(path) FROM photos) THEN 270 ELSE user_rotation END AS INT) AS user_rotation FROM photos")
_add("g11_rotate_cw", lambda t: lookups.rotations(mutations.rotate(t.photos, t.min_path(), 90)), "SELECT path, CAST(((CASE coalesce(exif_orientation, 1) WHEN 6 THEN 90 WHEN 3 THEN 180 WHEN 8 THEN 270 ELSE 0 END + coalesce(user_rotation, 0) + CASE WHEN path = (SELECT min(path) FROM photos) THEN 90 ELSE 0 END) % 360 + 360) % 360 AS INT) AS rotation FROM photos")
_add("g13_reset_rotation", lambda t: mutations.set_rotation(t.photos, t.min_path(), 0).select("id", "user_rotation"), "SELECT id, CAST(CASE WHEN path = (SELECT min(path) FROM photos) THEN 0 ELSE user_rotation END AS INT) AS user_rotation FROM photos")
_add("g15_unmark", lambda t: mutations.mark(t.photos, [1, 2, 3], False).select("id", "marked_for_deletion"), "SELECT id, CASE WHEN id IN (1, 2, 3) THEN false ELSE marked_for_deletion END AS marked_for_deletion FROM photos")
_add("g19_restore", lambda t: mutations.restore(mutations.move_to_trash(t.photos, 4, "/trash/4", NOW), 4).select("id", "path", "original_path"), f"SELECT id, path, {_set('original_path', 4, 'NULL')} FROM photos")
_add("g20_delete_trashed", lambda t: mutations.delete(t.photos, F.col("id") == 4).select("id"), "SELECT id FROM photos WHERE id <> 4")
_add("g21_create_person", lambda t: _appended(t.people, "name", "Zoe"), "SELECT id, name FROM people UNION ALL SELECT max(id) + 1, 'Zoe' FROM people")
_add("g23_rename_person", lambda t: mutations.rename(t.people, 2, "Zoe").select("id", "name"), f"SELECT id, {_set('name', 2, chr(39) + 'Zoe' + chr(39))} FROM people")
_add("g24_delete_person", lambda t: _cascaded(t, "people", 2)["faces"].select("id", "person_id"), "SELECT id, CASE WHEN person_id <> 2 THEN person_id END AS person_id FROM faces")
_add("g25_store_face", lambda t: _appended(t.faces, "photo_id", 5), "SELECT id, photo_id FROM faces UNION ALL SELECT max(id) + 1, 5 FROM faces")
_add("g26_assign_face", lambda t: mutations.assign_faces(t.faces, [3], 1).select("id", "person_id"), f"SELECT id, {_set('person_id', 3, 1)} FROM faces")
_add("g27_unassign_face", lambda t: mutations.assign_faces(t.faces, [3], None).select("id", "person_id"), f"SELECT id, {_set('person_id', 3, 'NULL')} FROM faces")
_add("g28_mark_scanned", lambda t: mutations.latest_wins(t.faces.select("photo_id", "id", "created_at"), ["photo_id"], "id"), "SELECT photo_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY id DESC) AS r FROM faces) WHERE r = 1")
_add("g29_set_vector", lambda t: mutations.update(t.faces, F.col("id") == 3, {"embedding_dim": F.lit(2)}).select("id", "embedding_dim"), f"SELECT id, {_set('embedding_dim', 3, 2)} FROM faces")
_add("g30_create_cluster", lambda t: _appended(t.face_clusters, "auto_name", "new"), "SELECT id, auto_name FROM face_clusters UNION ALL SELECT max(id) + 1, 'new' FROM face_clusters")
_add("g31_add_to_cluster", lambda t: mutations.upsert(t.face_cluster_members.select("face_id", "cluster_id", "similarity_score"), t.faces.where("person_id = 1").select(F.col("id").alias("face_id"), F.lit(1).cast("bigint").alias("cluster_id"), F.lit(0.5).alias("similarity_score")), ["face_id", "cluster_id"]), "SELECT face_id, cluster_id, similarity_score FROM face_cluster_members WHERE NOT (cluster_id = 1 AND face_id IN (SELECT id FROM faces WHERE person_id = 1)) UNION ALL SELECT id, 1, 0.5 FROM faces WHERE person_id = 1")
_add("g32_clear_clusters", lambda t: relations.count(mutations.delete(t.face_clusters, F.lit(True))), "SELECT 0::BIGINT AS n")
_add("g35_create_task", lambda t: _appended(t.scheduled_tasks, "task_type", "scan"), "SELECT id, task_type FROM scheduled_tasks UNION ALL SELECT max(id) + 1, 'scan' FROM scheduled_tasks")
for _n, _s in (("g37_cancel", "cancelled"), ("g40_complete", "completed"), ("g41_fail", "failed")):
    _add(_n, lambda t, _s=_s: mutations.set_status(t.scheduled_tasks.withColumns({"completed_at": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string")}), 5, _s, NOW, "why").select("id", "status", "completed_at", "error_message"), f"SELECT id, CASE WHEN id = 5 THEN '{_s}' ELSE status END AS status, CASE WHEN id = 5 THEN '{NOW}' END AS completed_at, CASE WHEN id = 5 THEN 'why' END AS error_message FROM scheduled_tasks")
_add("g38_delete_task", lambda t: mutations.delete_ids(t.scheduled_tasks, [5]).select("id"), "SELECT id FROM scheduled_tasks WHERE id <> 5")
_add("g43_get_or_create_tag", lambda t: mutations.insert_new(t.user_tags.select("id", F.lower("name").alias("name")), t.photos.where("camera_make IS NOT NULL").select(F.lower("camera_make").alias("name")).distinct(), ["name"], ["name"]), "SELECT id, lower(name) AS name FROM user_tags UNION ALL SELECT (SELECT max(id) FROM user_tags) + row_number() OVER (ORDER BY m), m FROM (SELECT DISTINCT lower(camera_make) AS m FROM photos WHERE camera_make IS NOT NULL AND lower(camera_make) NOT IN (SELECT lower(name) FROM user_tags))")
_add("g44_delete_tag", lambda t: _cascaded(t, "user_tags", 2)["photo_user_tags"].select("photo_id", "tag_id"), "SELECT photo_id, tag_id FROM photo_user_tags WHERE tag_id <> 2")
_add("g45_rename_tag", lambda t: mutations.rename(t.user_tags, 2, "new").select("id", "name"), f"SELECT id, {_set('name', 2, chr(39) + 'new' + chr(39))} FROM user_tags")
_add("g46_cascade_photos", lambda t: _cascaded(t, "photos", 5)["faces"].select("id"), "SELECT id FROM faces WHERE photo_id <> 5")
_add("g46_cascade_members", lambda t: _cascaded(t, "photos", 5)["face_cluster_members"].select("face_id", "cluster_id"), "SELECT face_id, cluster_id FROM face_cluster_members WHERE face_id NOT IN (SELECT id FROM faces WHERE photo_id = 5)")
_add("g48_untag", lambda t: mutations.delete(t.photo_user_tags, (F.col("photo_id") == 5) & (F.col("tag_id") == 2)).select("photo_id", "tag_id"), "SELECT photo_id, tag_id FROM photo_user_tags WHERE NOT (photo_id = 5 AND tag_id = 2)")
_add("g49_create_album", lambda t: _appended(t.albums, "name", "new"), "SELECT id, name FROM albums UNION ALL SELECT max(id) + 1, 'new' FROM albums")
_add("g50_delete_album", lambda t: _cascaded(t, "albums", 4)["album_photos"].select("album_id", "photo_id"), "SELECT album_id, photo_id FROM album_photos WHERE album_id <> 4")
_add("g51_add_to_album", lambda t: mutations.insert_ignore(t.album_photos.select("album_id", "photo_id"), t.photos.where("is_favorite").select(F.lit(4).cast("bigint").alias("album_id"), F.col("id").alias("photo_id")), ["album_id", "photo_id"]), "SELECT album_id, photo_id FROM album_photos UNION SELECT 4, id FROM photos WHERE is_favorite")
_add("g52_remove_from_album", lambda t: mutations.delete(t.album_photos, F.col("album_id") == 4).select("album_id", "photo_id"), "SELECT album_id, photo_id FROM album_photos WHERE album_id <> 4")
_add("g54_set_prompt", lambda t: mutations.set_prompt(t.directory_prompts.withColumn("updated_at", F.lit(NOW)), CAMERA_ROLL, "p", NOW).select("directory", "custom_prompt"), f"SELECT directory, custom_prompt FROM directory_prompts WHERE directory <> '{CAMERA_ROLL}' UNION ALL SELECT '{CAMERA_ROLL}', 'p'")

# further pipelines, names and display
_add("h2_conformed", lambda t: schema.conform(t.incoming_photos, "photos").select("id", "exif_orientation", "user_rotation", "taken_at"), "SELECT id, 1 AS exif_orientation, 0 AS user_rotation, NULL::VARCHAR AS taken_at FROM incoming_photos")
_add("h6_rescan", lambda t: pipelines.files_to_rescan(pipelines.detect_changes(t.incoming_photos.select("path", F.lit("2019-01-01 00:00:00").cast("timestamp").alias("mtime")).distinct(), t.photos)), "SELECT DISTINCT path FROM incoming_photos WHERE path NOT IN (SELECT path FROM photos)")
_add("h8_trash_names", lambda t: t.photos.select("id", pipelines.trash_name(F.col("filename"), 1_700_000_000, F.col("id")).alias("name")), "SELECT id, regexp_replace(filename, '(.)\\.[^.]*$', '\\1') || '_1700000000_' || id || regexp_extract(filename, '.(\\.[^.]*)$', 1) AS name FROM photos")
_add("h14_overdue_count", lambda t: relations.count(lookups.overdue(t.scheduled_tasks, NOW)), f"SELECT count(*) AS n FROM scheduled_tasks WHERE status = 'pending' AND scheduled_at < '{NOW}'")
_add("i4_filename_parts", lambda t: pipelines.filename_parts(t.photos).select("id", "p_date", "p_ext", "p_stem"), "SELECT id, CASE WHEN regexp_full_match(taken_at, '\\d{4}[-:]\\d{2}[-:]\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN strftime(try_strptime(taken_at, ['%Y-%m-%d %H:%M:%S', '%Y:%m:%d %H:%M:%S']), '%Y%m%d') END AS p_date, coalesce(nullif(lower(regexp_extract(path, '\\.([^./]+)$', 1)), ''), 'jpg') AS p_ext, regexp_replace(filename, '(.)\\.[^.]*$', '\\1') AS p_stem FROM photos")
_STAMP = "CASE WHEN regexp_full_match(taken_at, '\\d{4}[-:]\\d{2}[-:]\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN strftime(try_strptime(taken_at, ['%Y-%m-%d %H:%M:%S', '%Y:%m:%d %H:%M:%S']), '%Y%m%d-%H%M') END"
_add("i5_filenames", lambda t: pipelines.filename_parts(t.photos).select("id", pipelines.render_filename(F.lit(1)).alias("name")), f"""WITH a AS (SELECT id, {_STAMP} AS stamp, coalesce({_CHAIN('tags')}, {_CHAIN('description')}) AS event, array_to_string(list_filter(regexp_split_to_array(split_part(description, '.', 1), '\\s+'), lambda x: x <> '')[1:4], ' ') AS words, regexp_replace(filename, '(.)\\.[^.]*$', '\\1') AS stem, coalesce(nullif(lower(regexp_extract(path, '\\.([^./]+)$', 1)), ''), 'jpg') AS ext FROM photos),
 b AS (SELECT *, list_filter([stamp, event, {_SANE('words')}], lambda x: x IS NOT NULL AND x <> '') AS parts FROM a),
 c AS (SELECT *, array_to_string(CASE WHEN len(parts) = 0 OR (len(parts) = 1 AND stamp IS NULL) THEN ['{X.NO_CATEGORY}', {_SANE('stem')}] ELSE parts END, '_') || '_001' AS name, 99 - length(ext) AS room FROM b)
 SELECT id, CASE WHEN length(name) > room THEN regexp_replace(substr(name, 1, room), '[_-]+$', '') ELSE name END || '.' || ext AS name FROM c""")
_add("j1_ranks", lambda t: pipelines.gallery_ranks(t.photos), "SELECT id, row_number() OVER (ORDER BY filename NULLS FIRST, id) AS name_rank, row_number() OVER (ORDER BY modified_at DESC NULLS LAST, id) AS date_rank, row_number() OVER (ORDER BY size_bytes DESC NULLS LAST, id) AS size_rank FROM photos")
_FOLDER = "concat('/library/', CASE WHEN try_strptime(taken_at, ['%Y-%m-%d %H:%M:%S', '%Y:%m:%d %H:%M:%S']) IS NOT NULL AND regexp_full_match(taken_at, '\\d{4}[-:]\\d{2}[-:]\\d{2} \\d{2}:\\d{2}:\\d{2}') THEN strftime(try_strptime(taken_at, ['%Y-%m-%d %H:%M:%S', '%Y:%m:%d %H:%M:%S']), '%Y/%m') ELSE 'unknown' END)"
_add(
    "i7_organise", lambda t: pipelines.organise(t.photos, "/library"),
    f"""WITH RECURSIVE m AS ({ORACLE_SQL['i5_filenames']}),
 o AS MATERIALIZED (SELECT p.id, path, {_FOLDER} AS folder, regexp_replace(name, '...\\.[^.]*$', '') AS base, regexp_extract(name, '\\.([^.]*)$', 1) AS ext, row_number() OVER (ORDER BY {_FOLDER}, path) AS i FROM photos p JOIN m ON m.id = p.id),
 st(i, folder, counter, seen) AS (SELECT 0::BIGINT, '', 1, []::VARCHAR[] UNION ALL SELECT o.i, o.folder, CASE WHEN o.folder <> st.folder THEN 1 WHEN list_contains(st.seen, o.base || '.' || o.ext) THEN st.counter + 1 ELSE st.counter END,
  CASE WHEN o.folder <> st.folder OR list_contains(st.seen, o.base || '.' || o.ext) THEN [o.base || '.' || o.ext] ELSE list_append(st.seen, o.base || '.' || o.ext) END FROM st JOIN o ON o.i = st.i + 1)
 SELECT o.id, o.path, o.folder || '/' || o.base || printf('%03d', counter) || '.' || o.ext AS destination FROM o JOIN st ON st.i = o.i""",
)
_add("j8_paste", lambda t: t.incoming_photos.select(X.basename(F.col("path")).alias("filename")).distinct().join(t.photos.select("filename"), "filename", "left_anti"), "SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS filename FROM incoming_photos WHERE regexp_extract(path, '([^/]*)$', 1) NOT IN (SELECT filename FROM photos)")
_add("l2_prompts", lambda t: t.photos.join(t.directory_prompts, "directory", "left").select("id", pipelines.prompt(F.lit("Describe."), F.col("custom_prompt")).alias("prompt")), "SELECT p.id, CASE WHEN d.custom_prompt <> '' THEN 'Context: ' || d.custom_prompt || chr(10) || chr(10) || 'Describe.' ELSE 'Describe.' END AS prompt FROM photos p LEFT JOIN directory_prompts d ON d.directory = p.directory")
_add("b6_copy_missing", lambda t: exports.copy_missing(t.photos.select("id"), t.photos.where("is_favorite").select("id"), ["id"]), "SELECT id FROM photos WHERE NOT coalesce(is_favorite, false)")
_TOPS = ["photos", "people", "faces", "face_clusters", "similarity_groups", "user_tags", "albums", "scheduled_tasks"]
_add("b7_watermarks", lambda t: reduce(DataFrame.unionByName, [getattr(t, n).agg(F.max("id").alias("top")).select(F.lit(n).alias("table_name"), "top") for n in _TOPS]), " UNION ALL ".join(f"SELECT '{n}' AS table_name, max(id) AS top FROM {n}" for n in _TOPS))
_add("b2_json_rows", lambda t: lookups.export_rows(t.photos).select("path", F.to_json(F.struct(*lookups.EXPORT), {"ignoreNullFields": "false"}).alias("line")), "SELECT path, '{' || concat_ws(',', " + ", ".join(f"'\"{c}\":' || " + (f"coalesce(CAST({c} AS VARCHAR), 'null')" if c in ("size_bytes", "width", "height") else f"coalesce(CAST(to_json({BASE if c == 'filename' else c}) AS VARCHAR), 'null')") for c in lookups.EXPORT) + ") || '}' AS line FROM photos")
