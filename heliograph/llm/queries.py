"""Queries pN_ of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import batches, components, leaks, linkage, linking, packing, stuffing, survivors, vectors
from heliograph.operators import timestamps
from heliograph.runtime import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    photo = table(spark, root, "photo_embeddings").select(F.lit("photo").alias("kind"), F.col("photo_id").alias("id"), F.col("embedding").alias("vector"))
    face = table(spark, root, "faces").select(F.lit("face").alias("kind"), "id", F.col("embedding").alias("vector"))
    return vectors.neighbours(photo.unionByName(face), 0.8, 5)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    links = linking.photo_links(table(spark, root, "photo_similarity"), table(spark, root, "photos"))
    return components.connected_components(links).select(F.col("vertex").alias("photo_id"), F.col("component").alias("group_key"))


def _group_members(spark: SparkSession, root: str) -> DataFrame:
    photos = table(spark, root, "photos").select(
        "id", "path", "taken_at", "modified_at", "scanned_at", "all_exif", "width", "height", "size_bytes", "camera_model", "gps_latitude", "gps_longitude", "trashed_at"
    )
    roots = table(spark, root, "library_roots")
    taken = timestamps.taken_instants(photos, roots, source="source")
    return survivors.members(table(spark, root, "photo_similarity"), table(spark, root, "similarity_groups"), taken)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The preferences alone decide; ``p2_survivors`` tells how probable they are."""
    return survivors.surviving_members(_group_members(spark, root))


def p2_survivors(spark: SparkSession, root: str) -> DataFrame:
    """The rows of ``p2_found`` with the posterior of each value, by accuracies and copying of the library directories."""
    return survivors.best_members(_group_members(spark, root))


def p2_fused(spark: SparkSession, root: str) -> DataFrame:
    """Values of each group's fields where any other value may be false."""
    rows = _group_members(spark, root)
    fields = {"width": F.when(F.col("width") > 0, F.col("width")), "size_bytes": F.col("size_bytes"), "taken_at": F.col("taken_us"), "camera_model": F.col("camera_model")}
    claims = rows.select(
        F.col("group_id").alias("item"), "source", F.inline(F.array(*(F.struct(F.lit(k).alias("field_name"), v.cast("string").alias("value")) for k, v in fields.items())))
    )
    return survivors.fuse(claims).withColumnRenamed("item", "group_id")


def _faces(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "faces").select("id", F.col("embedding").alias("vector"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    member, clusters = linkage.cluster(_faces(spark, root))
    several = clusters.where("size > 1").select("cluster")
    return member.join(several, "cluster", "left_semi").select(F.col("id").alias("face_id"), F.col("cluster").alias("cluster_key"))


def p5_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Each cluster's face count and most typical faces."""
    faces = _faces(spark, root)
    described = linkage.describe(faces, *linkage.cluster(faces))
    return described.select(F.col("cluster").alias("cluster_key"), F.col("size").alias("face_count"), F.col("representative").alias("representative_face_id"), F.col("typical").alias("typical_face_ids"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    history = batches.records(table(spark, root, "photos"), F.lit(0))
    incoming = batches.records(table(spark, root, "incoming_photos"), F.col("batch_no"))
    return batches.find_duplicates(history.unionByName(incoming)).select(F.col("id_a").alias("photo_id_a"), F.col("id_b").alias("photo_id_b"))


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """Each document's container of 2,048 tokens."""
    return packing.pack(packing.token_counts(table(spark, root, "documents")))


def p8_audit(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the containers: each document is placed, none overflows, none is split without need or torn apart."""
    placed = packing.pack(packing.token_counts(table(spark, root, "documents")))
    own = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max("piece").alias("last"), F.sum("tokens").alias("tokens"), F.countDistinct("piece").alias("different"))
    documents = own.agg(
        F.count("*").alias("documents"),
        F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= packing.CAPACITY), 1)).alias("split_without_need"),
        F.count(F.when((F.col("pieces") != F.col("last") + 1) | (F.col("different") != F.col("pieces")), 1)).alias("torn"),
    )
    used = placed.groupBy("container_id").agg(F.sum("tokens").alias("used"))
    full = used.agg(F.count(F.when(F.col("used") > packing.CAPACITY, 1)).alias("overfull"), (F.sum("used") >= 0.98 * packing.CAPACITY * F.count(F.when(F.col("used") > 0, 1))).alias("nearly_full"))
    return documents.join(full, F.lit(True))  # one row each


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return stuffing.find_spam(table(spark, root, "documents")).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_survivors": p2_survivors, "p2_fused": p2_fused, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_clusters": p5_clusters, "p7_found": p7_found, "p8_containers": p8_containers, "p8_audit": p8_audit, "p9_found": p9_found, "p10_found": p10_found}
# Hashes as upper-case hexadecimal text, null where they do not give 256 bits.
_B64 = "hex(from_base64(CASE WHEN regexp_full_match({0}, '[A-Za-z0-9+/_-]{{43}}=?') THEN replace(translate({0}, '-_', '+/'), '=', '') || '=' END))"
_HASH = f"CASE WHEN regexp_full_match({{0}}, '[0-9A-Fa-f]{{{{64}}}}') THEN upper({{0}}) ELSE {_B64} END"
_BARE = "regexp_replace({0}, '^0[xX]([0-9A-Fa-f]{{64}})$', '\\1')"
_PERCEPTUAL = "nullif(" + _HASH.format(_BARE.format("regexp_replace(perceptual_hash, '\\s+', '', 'g')")) + ", repeat('0', 64))"
_SHA = _HASH.format(_BARE.format("regexp_replace(regexp_replace(sha256_hash, '\\s+', '', 'g'), '^(?i:sha-?256[:=-])', '')"))
_USABLE = "len({0}) = 128 AND len(list_filter({0}, lambda x: x IS NOT NULL AND isfinite(x))) = 128 AND len(list_filter({0}, lambda x: x <> 0)) > 0"


def _cosines(table_: str, key: str) -> str:
    unit = f"SELECT {key} AS i, embedding::DOUBLE[] AS e FROM {table_} WHERE {_USABLE.format('embedding')}"
    return f"SELECT a.i AS a, b.i AS b, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM ({unit}) a JOIN ({unit}) b ON a.i <> b.i"


def _nearest(kind: str, table_: str, key: str) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM ({_cosines(table_, key)})"
    return f"SELECT DISTINCT '{kind}' AS kind, least(a, b) AS id_a, greatest(a, b) AS id_b FROM ({ranked}) WHERE r <= 5 AND c >= 0.8"


_WORDS = (
    "regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '</?em>', '', 'g'), '</?[A-Za-z][^<>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), "
    "'[\u00ad\u200b-\u200f\u2060\ufeff]', '', 'g')), '[\\p{L}\\p{N}]+')"
)


def _grams(key: str, table_: str) -> str:
    listed = "unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' ')))"
    return f"SELECT {key} AS id, {listed} AS g FROM (SELECT {key}, {_WORDS} AS w FROM {table_} WHERE text IS NOT NULL)"


ORACLE_SQL: dict[str, str] = {
    "p3_found": f"{_nearest('photo', 'photo_embeddings', 'photo_id')} UNION ALL {_nearest('face', 'faces', 'id')}",
    "p4_found": f"""WITH RECURSIVE s AS (SELECT photo_id, group_id FROM photo_similarity WHERE CASE WHEN similarity_score > 1 THEN similarity_score / 100 ELSE similarity_score END >= 0.8),
 h AS (SELECT id, {_PERCEPTUAL} AS bits FROM photos),
 e AS MATERIALIZED (SELECT DISTINCT a.photo_id AS a, b.photo_id AS b FROM s a JOIN s b USING (group_id) WHERE a.photo_id <> b.photo_id UNION SELECT a.id, b.id FROM h a JOIN h b USING (bits) WHERE a.id <> b.id),
 r AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w)
 SELECT v AS photo_id, min(w) AS group_key FROM r GROUP BY v""",
    "p5_found": f"WITH c AS MATERIALIZED ({_cosines('faces', 'id')}) SELECT a AS face_id, least(a, min(b)) AS cluster_key FROM c WHERE c >= 0.7 GROUP BY a",
    "p7_found": f"""WITH x AS MATERIALIZED (SELECT id, 0 AS batch, {_SHA} AS sha, {_PERCEPTUAL} AS bits FROM photos UNION ALL SELECT id, batch_no, {_SHA}, {_PERCEPTUAL} FROM incoming_photos),
 w AS MATERIALIZED (SELECT id, batch, sha, list_transform(range(4), lambda k: CAST('0x' || substr(bits, 16 * k + 1, 16) AS UBIGINT)) AS q FROM x)
 SELECT DISTINCT least(a.id, b.id) AS photo_id_a, greatest(a.id, b.id) AS photo_id_b FROM w a JOIN w b ON b.batch < a.batch
 WHERE a.sha = b.sha OR bit_count(xor(a.q[1], b.q[1]))::INT + bit_count(xor(a.q[2], b.q[2]))::INT + bit_count(xor(a.q[3], b.q[3]))::INT + bit_count(xor(a.q[4], b.q[4]))::INT <= 16""",
    "p8_audit": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS split_without_need, 0::BIGINT AS torn, 0::BIGINT AS overfull, true AS nearly_full FROM documents",
    "p9_found": f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM ({_grams('doc_id', 'documents')}) d JOIN ({_grams('item_id', 'eval_items')}) i USING (g)",
}
