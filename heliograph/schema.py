"""Fixed schemas of the catalogue's 17 tables, and a step that brings any DataFrame into one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the catalogue; "!" marks NOT NULL, "=" a default.
_TABLES = {
    "photos": "id bigint!, path string!, filename string!, directory string!, size_bytes bigint!, created_at string, modified_at string, scanned_at string!, width int, height int, format string, camera_make string, camera_model string, lens string, focal_length double, aperture double, shutter_speed string, iso int, taken_at string, gps_latitude double, gps_longitude double, exif_orientation int=1, user_rotation int=0, all_exif string, md5_hash string, sha256_hash string, perceptual_hash string, description string, tags string, llm_processed_at string, marked_for_deletion boolean=false, is_favorite boolean=false, original_path string, trashed_at string",
    "similarity_groups": "id bigint!, created_at string!, group_type string!, representative_photo_id bigint",
    "photo_similarity": "photo_id bigint!, group_id bigint!, similarity_score double, is_representative boolean=false",
    "scans": "id bigint!, directory string!, started_at string!, completed_at string, photos_found int=0, photos_new int=0, photos_updated int=0, status string=running",
    "llm_queue": "id bigint!, photo_id bigint!, status string=pending, queued_at string!, started_at string, completed_at string, error_message string",
    "embeddings": "photo_id bigint!, embedding array<float>!, embedding_dim int!, model_name string!, created_at string!",
    "people": "id bigint!, name string!, created_at string!, updated_at string!",
    "faces": "id bigint!, photo_id bigint!, bbox_x int!, bbox_y int!, bbox_w int!, bbox_h int!, embedding array<float>, embedding_dim int, person_id bigint, confidence double, created_at string!",
    "face_clusters": "id bigint!, representative_face_id bigint, auto_name string, created_at string!",
    "face_cluster_members": "face_id bigint!, cluster_id bigint!, similarity_score double",
    "face_scans": "photo_id bigint!, scanned_at string!, faces_found int!=0",
    "scheduled_tasks": "id bigint!, task_type string!, target_path string!, photo_ids string, scheduled_at string!, hours_start int, hours_end int, status string=pending, created_at string, started_at string, completed_at string, error_message string",
    "user_tags": "id bigint!, name string!, color string=#808080, created_at string!",
    "photo_user_tags": "photo_id bigint!, tag_id bigint!, created_at string!",
    "albums": "id bigint!, name string!, description string, cover_photo_id bigint, is_smart boolean=false, filter_tags string, created_at string!, updated_at string!",
    "album_photos": "album_id bigint!, photo_id bigint!, position int=0, added_at string!",
    "directory_prompts": "directory string!, custom_prompt string!, updated_at string!",
}
#: Primary keys.
KEYS = {
    **{t: ["id"] for t in ("photos", "similarity_groups", "scans", "llm_queue", "people", "faces", "face_clusters", "scheduled_tasks", "user_tags", "albums")},
    "photo_similarity": ["photo_id", "group_id"], "embeddings": ["photo_id"], "face_cluster_members": ["face_id", "cluster_id"], "face_scans": ["photo_id"],
    "photo_user_tags": ["photo_id", "tag_id"], "album_photos": ["album_id", "photo_id"], "directory_prompts": ["directory"],
}
#: (child, column, parent, action) of every foreign key with an action.
REFERENCES = [
    ("photo_similarity", "photo_id", "photos", "cascade"), ("photo_similarity", "group_id", "similarity_groups", "cascade"), ("llm_queue", "photo_id", "photos", "cascade"),
    ("embeddings", "photo_id", "photos", "cascade"), ("faces", "photo_id", "photos", "cascade"), ("faces", "person_id", "people", "set null"),
    ("face_clusters", "representative_face_id", "faces", "set null"), ("face_cluster_members", "face_id", "faces", "cascade"), ("face_cluster_members", "cluster_id", "face_clusters", "cascade"),
    ("face_scans", "photo_id", "photos", "cascade"), ("photo_user_tags", "photo_id", "photos", "cascade"), ("photo_user_tags", "tag_id", "user_tags", "cascade"),
    ("albums", "cover_photo_id", "photos", "set null"), ("album_photos", "album_id", "albums", "cascade"), ("album_photos", "photo_id", "photos", "cascade"),
]

#: All tables, each after those that it refers to.
PARENTS_FIRST = [
    "photos", "similarity_groups", "photo_similarity", "scans", "llm_queue", "embeddings", "people", "faces", "face_clusters", "face_cluster_members", "face_scans", "scheduled_tasks",
    "user_tags", "photo_user_tags", "albums", "album_photos", "directory_prompts",
]

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "array<float>": T.ArrayType(T.FloatType())}


def _parse(spec: str) -> tuple[T.StructType, dict[str, str]]:
    fields, defaults = [], {}
    for item in spec.split(", "):
        name, kind = item.split(" ", 1)
        kind, _, default = kind.partition("=")
        if default:
            defaults[name] = default
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields), defaults


SCHEMAS = {name: _parse(spec)[0] for name, spec in _TABLES.items()}
DEFAULTS = {name: _parse(spec)[1] for name, spec in _TABLES.items()}


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with just the columns of table ``name``: missing ones with their default, present ones cast."""
    defaults = DEFAULTS[name]
    out = []
    for f in SCHEMAS[name].fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)
