"""New batches against everything accepted before, by exact and near fingerprints.

A record's fingerprints are its digest and the bands of its 256-bit perceptual hash. With 9 bands, two hashes that differ in
at most 16 bits have a band in which they differ in at most one bit. So the history stores each band once, and a new record
looks for each of its bands and all their one-bit neighbours: 265 keys, of which one suffices.

Those keys first meet partitioned Bloom filters (one filter a partition of the key space, so neither a worker nor the driver
holds a filter of the whole history), and only the positives are looked up in the fingerprint store and verified in full.
Equal values are one class throughout, so a value that a third of all records share is stored and compared once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.hashes import hamming, perceptual_bits, sha256_bytes, words64
from heliograph.runtime import cut, cut_small, ensure_checkpoint_dir, seen_by

MAX_BITS = 16
#: 9 bands: were all of them to differ in two bits or more, 18 bits would differ.
BANDS = 9
#: Bits of a Bloom filter for each key, and probes; about 1 % false positives.
BLOOM_BITS, BLOOM_PROBES = 10, 7
#: Keys of one Bloom partition at most, about (0.6 MB of filter).
BLOOM_KEYS = 500_000
#: Bytes of all filters up to which they are sent to the probes; beyond that the probes go to the filters.
SENT_FILTERS = 16 << 20
#: Generations of a store after which they are merged into one.
GENERATIONS = 24
#: Records of one class that one task pairs, about.
CLASS_PART = 10_000
_EDGES = [256 * k // BANDS for k in range(BANDS + 1)]
#: Kinds of values.
BITS, SHA = 0, 1


def records(df: DataFrame, batch: Column) -> DataFrame:
    """(id, batch, sha, bits): null where a hash is null, unreadable or, for perceptual hashes, all zero."""
    return df.select("id", batch.cast("int").alias("batch"), sha256_bytes(F.col("sha256_hash")).alias("sha"), perceptual_bits(F.col("perceptual_hash")).alias("bits"))


def values(rows: DataFrame) -> DataFrame:
    """(id, kind, value) and the other columns of ``rows``: one row for each digest and each perceptual hash that is known."""
    kept = [c for c in rows.columns if c not in ("sha", "bits")]
    both = F.array(F.struct(F.lit(BITS).alias("kind"), F.col("bits").alias("value")), F.struct(F.lit(SHA).alias("kind"), F.col("sha").alias("value")))
    return rows.select(*kept, F.inline(both)).where("value IS NOT NULL")


def _bands(bits: list[bytes]) -> np.ndarray:
    """The bands of hashes as (n, BANDS) integers; bits count from the first byte's highest."""
    raw = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(-1, 32), axis=1).astype(np.int64)
    return np.stack([raw[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64)[::-1]) for a, b in zip(_EDGES, _EDGES[1:], strict=False)], axis=1)


def _fingerprints(classes: np.ndarray, kinds: np.ndarray, held: list[bytes], near: bool) -> tuple[np.ndarray, np.ndarray]:
    """(class, key) of values: digests have one key, perceptual hashes one a band, with all one-bit neighbours if ``near``.

    A key holds the band's number in its upper bits; those of digests are negative.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    at = np.flatnonzero(kinds == SHA)
    if len(at):
        out.append((classes[at], np.frombuffer(b"".join(held[k][:8] for k in at), ">i8").astype(np.int64) | np.int64(-(1 << 63))))
    at = np.flatnonzero(kinds == BITS)
    if len(at):
        bands = _bands([held[k] for k in at])
        for k in range(BANDS):
            own = bands[:, k : k + 1]
            if near:
                own = own ^ np.concatenate([[0], 1 << np.arange(_EDGES[k + 1] - _EDGES[k], dtype=np.int64)])[None, :]
            out.append((np.repeat(classes[at], own.shape[1]), (own | (k << 40)).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    h1, h2 = _mix(keys, 1), _mix(keys, 2) | np.uint64(1)
    return ((h1[:, None] + h2[:, None] * np.arange(BLOOM_PROBES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def _part_of(keys: np.ndarray, partitions: int) -> np.ndarray:
    return (_mix(keys, 3) % np.uint64(partitions)).astype(np.int32)


def _hits(keys: np.ndarray, raw: bytes) -> np.ndarray:
    """Whether a filter may hold each key; its bits are read where they lie."""
    held = np.frombuffer(raw, np.uint8)
    out = np.empty(len(keys), bool)
    for start in range(0, len(keys), 200_000):
        slots = _slots(keys[start : start + 200_000], len(held) * 8)
        out[start : start + 200_000] = ((held[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).all(axis=1)
    return out


def _build(part: pd.DataFrame) -> pd.DataFrame:
    keys = part["key"].unique()
    size = max(64, (len(keys) * BLOOM_BITS + 7) // 8 * 8)
    filter_ = np.zeros(size, bool)
    for start in range(0, len(keys), 200_000):
        filter_[_slots(keys[start : start + 200_000], size).ravel()] = True
    return pd.DataFrame({"part": [part["part"].iloc[0]], "filter": [np.packbits(filter_).tobytes()]})


def keyed(classes: DataFrame, partitions: int, near: bool, filters: dict[int, list[bytes]] | None = None) -> DataFrame:
    """(class, key, part) of ``classes`` (class, kind, value); with ``filters`` only the keys that one of their part may hold."""
    sent = None if filters is None else classes.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                some = batch.slice(start, 2000)
                owner, key = _fingerprints(some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2).to_pylist(), near)
                part = _part_of(key, partitions)
                if sent is not None:
                    order = np.argsort(part, kind="stable")
                    owner, key, part = owner[order], key[order], part[order]
                    keep = np.zeros(len(key), bool)
                    ends = np.searchsorted(part, np.arange(partitions + 1))
                    for p in range(partitions):
                        for raw in sent.value.get(p, ()):
                            keep[ends[p] : ends[p + 1]] |= _hits(key[ends[p] : ends[p + 1]], raw)
                    owner, key, part = owner[keep], key[keep], part[keep]
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(key), pa.array(part)], names=["class", "key", "part"])

    return classes.select("class", "kind", "value").mapInArrow(run, "class bigint, key bigint, part int")


def _sift(probes: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(probes), bool)
    for raw in filters["filter"]:
        hit |= _hits(probes["key"].to_numpy(), raw)
    return probes.loc[hit, ["class", "key", "part"]]


class FingerprintStore:
    """A persistent store of accepted values under one shared folder: their keys, Bloom filters and the values themselves.

    ``screen`` compares a batch with everything accepted so far and ``accept`` adds it. A batch's probes meet the filters;
    only the positives are looked up among the stored keys, which are laid out by partition and sorted, and only what shares
    a key is verified. The history's records are never read again.

    Each accepted batch is a generation of files that counts once the list of generations names it, which one rename does;
    an accept that fails leaves nothing behind that is read. After ``GENERATIONS`` of them they are merged into one, with as
    many partitions as the keys then need, so filters stay bounded and few. One writer at a time.
    """

    _SCHEMAS = {"keys": "class bigint, key bigint, part int", "filters": "part int, filter binary", "values": "class bigint, kind int, value binary"}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._state = self._load()

    def _load(self) -> dict:
        names = self._path(f"{self.folder}/lists")
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(names) if s.getPath().getName().isdigit()] if self._fs.exists(names) else []
        if not numbers:
            return {"number": 0, "partitions": 0, "keys": 0, "generations": []}
        return json.loads(self.spark.read.text(f"{self.folder}/lists/{max(numbers)}").first()[0])

    def _commit(self, state: dict) -> None:
        draft = self._path(f"{self.folder}/lists/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(json.dumps(state).encode())
        out.close()
        if not self._fs.rename(draft, self._path(f"{self.folder}/lists/{state['number']}")):
            raise OSError(f"list {state['number']} of {self.folder} exists: the store has another writer")
        self._state = state

    def _read(self, name: str) -> DataFrame:
        held = self._state["generations"]
        if not held:
            return self.spark.createDataFrame([], self._SCHEMAS[name])
        return self.spark.read.schema(self._SCHEMAS[name]).parquet(*(f"{self.folder}/{g}/{name}" for g in held))

    def values(self) -> DataFrame:
        """(class, kind, value) of all that was accepted; a class is the smallest id of the first batch that had the value."""
        return self._read("values")

    def _write(self, name: str, classes: DataFrame, partitions: int) -> int:
        """A generation of the classes; the number of its keys."""
        classes.write.mode("overwrite").parquet(f"{self.folder}/{name}/values")
        seen = Observation()
        keys = keyed(classes, partitions, False).observe(seen, F.count(F.lit(1)).alias("n")).repartition(partitions, "part").sortWithinPartitions("part", "key")
        keys.write.mode("overwrite").parquet(f"{self.folder}/{name}/keys")
        written = self.spark.read.schema(self._SCHEMAS["keys"]).parquet(f"{self.folder}/{name}/keys")
        written.select("part", "key").groupBy("part").applyInPandas(_build, self._SCHEMAS["filters"]).coalesce(max(1, partitions // 64)).write.mode("overwrite").parquet(f"{self.folder}/{name}/filters")
        return seen_by(seen).get("n", 0)

    def _filters(self) -> dict[int, list[bytes]] | None:
        """The filters by partition, if all of them together are small."""
        if self._state["keys"] * BLOOM_BITS // 8 > SENT_FILTERS:
            return None
        out: dict[int, list[bytes]] = {}
        for part, raw in self._read("filters").collect():
            out.setdefault(part, []).append(bytes(raw))
        return out

    def screen(self, batch: DataFrame) -> DataFrame:
        """(kind, new_class, old_class, equal): the values of a batch and the accepted ones that match them.

        ``batch``: id, sha, bits. A batch's class is the smallest id that has the value in it. Digests match if equal,
        perceptual hashes if they differ in at most 16 of 256 bits. Null values match nothing, repeated rows count once.
        """
        none = "kind int, new_class bigint, old_class bigint, equal boolean"
        if not self._state["generations"]:
            return self.spark.createDataFrame([], none)
        fresh = cut_small(batch_classes(batch))
        partitions, filters = self._state["partitions"], self._filters()
        if filters is None:
            probes = keyed(fresh, partitions, True)
            positives = probes.groupBy("part").cogroup(self._read("filters").groupBy("part")).applyInPandas(_sift, self._SCHEMAS["keys"])
        else:
            positives = keyed(fresh, partitions, True, filters)
        positives = cut_small(positives.select(F.col("class").alias("new_class"), "key", "part"), 200_000)
        near = self._read("keys").withColumnRenamed("class", "old_class").join(positives, ["part", "key"]).select("new_class", "old_class").distinct()
        near = cut_small(near, 200_000)
        old = self._read("values").select(F.col("class").alias("old_class"), "kind", F.col("value").alias("old"))
        both = old.join(near, "old_class").join(fresh.select(F.col("class").alias("new_class"), "kind", F.col("value").alias("new")), ["new_class", "kind"])
        alike = F.when(F.col("kind") == SHA, F.col("old") == F.col("new")).otherwise(hamming(words64(F.col("old")), words64(F.col("new"))) <= MAX_BITS)
        return both.where(alike).select("kind", "new_class", "old_class", (F.col("old") == F.col("new")).alias("equal"))

    def accept(self, batch: DataFrame, screened: DataFrame | None = None) -> None:
        """Add the values of a batch (id, sha, bits) that are not there yet, by what ``screen`` said of it."""
        classes = batch_classes(batch)
        state = self._state
        if state["generations"]:
            screened = self.screen(batch) if screened is None else screened
            classes = classes.join(screened.where("equal").select("kind", F.col("new_class").alias("class")), ["kind", "class"], "left_anti")
        classes = cut(classes.select("class", "kind", "value"))
        number = state["number"] + 1
        partitions = state["partitions"] or max(1, -(-classes.count() * BANDS // BLOOM_KEYS))
        generations = [*state["generations"], f"g{number}-{uuid.uuid4().hex[:8]}"]
        keys = state["keys"] + self._write(generations[-1], classes, partitions)
        self._commit({"number": number, "partitions": partitions, "keys": keys, "generations": generations})
        if len(generations) > GENERATIONS:
            self.compact()

    def compact(self) -> None:
        """Merge all generations into one, with partitions for the keys there are; the old files are deleted after that."""
        state = self._state
        number, partitions = state["number"] + 1, max(1, -(-state["keys"] // BLOOM_KEYS))
        name = f"g{number}-{uuid.uuid4().hex[:8]}"
        keys = self._write(name, cut(self._read("values")), partitions)
        self._commit({"number": number, "partitions": partitions, "keys": keys, "generations": [name]})
        for old in state["generations"]:
            self._fs.delete(self._path(f"{self.folder}/{old}"), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.folder), True)


def batch_classes(batch: DataFrame) -> DataFrame:
    """(class, kind, value): the different values of a batch (id, sha, bits), each with the smallest id that has it."""
    return values(batch.select("id", "sha", "bits").where("id IS NOT NULL")).groupBy("kind", "value").agg(F.min(F.col("id").cast("bigint")).alias("class"))


def find_duplicates(rows: DataFrame) -> DataFrame:
    """Distinct (id_a, id_b), smaller id first: each record of a batch with its duplicates in smaller batches.

    ``rows``: id, batch, sha, bits as from ``records``; ids are unique over all batches. A pair matches if the digests are
    equal or the perceptual hashes differ in at most 16 of 256 bits. Null hashes match nothing, rows without an id or a
    batch are left out, records of one batch are not compared with each other, repeated rows count once, an empty table
    gives an empty result, further columns are ignored.

    Batch after batch is screened against a ``FingerprintStore`` and accepted into it. The links it gives are between
    classes of equal values; they are expanded to records at the end, large classes in parts.
    """
    spark = rows.sparkSession
    rows = cut(rows.where("id IS NOT NULL AND batch IS NOT NULL").select(F.col("id").cast("bigint"), "batch", "sha", "bits").distinct())
    numbers = sorted(r[0] for r in rows.select("batch").distinct().collect())  # as many as there are batches
    store = FingerprintStore(spark, f"{ensure_checkpoint_dir(spark)}/fingerprints-{uuid.uuid4().hex}")
    links = [spark.createDataFrame([], "batch int, kind int, new_class bigint, old_class bigint")]
    for number in numbers:
        batch = rows.where(F.col("batch") == number)
        found = cut_small(store.screen(batch))
        links.append(found.select(F.lit(number).alias("batch"), "kind", "new_class", "old_class"))
        store.accept(batch, found)
    told = cut(values(rows))
    old = cut(told.join(store.values(), ["kind", "value"]).select("kind", F.col("class").alias("old_class"), F.col("id").alias("y"), F.col("batch").alias("by")))
    store.drop()
    new = told.groupBy("batch", "kind", "value").agg(F.min("id").alias("new_class")).join(told, ["batch", "kind", "value"]).select("batch", "kind", "new_class", F.col("id").alias("x"))
    every = reduce(DataFrame.unionByName, links)
    large = cut_small(old.groupBy("kind", "old_class").agg(F.ceil(F.count("*") / CLASS_PART).cast("int").alias("parts")).where("parts > 1"))
    every = every.join(large, ["kind", "old_class"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    dealt = old.join(large, ["kind", "old_class"], "left").withColumn("salt", F.pmod(F.xxhash64("y"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    pairs = dealt.join(every, ["kind", "old_class", "salt"]).where("by < batch").join(new, ["batch", "kind", "new_class"])
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
