"""Batches against history, against a plain double loop."""

import random

from heliograph.llm import batches

SCHEMA = "id bigint, batch int, sha binary, bits binary"


def make(seed=5):
    rng = random.Random(seed)
    rows, hashes = [], []
    for k in range(300):
        if hashes and rng.random() < 0.5:
            bits = rng.choice(hashes)
            for b in rng.sample(range(256), rng.choice([0, 1, 15, 16, 17, 18, 40])):
                bits ^= 1 << b
        else:
            bits = rng.getrandbits(256)
        hashes.append(bits)
        sha = bytes([rng.randrange(200)] * 32) if rng.random() < 0.3 else None
        rows.append((k + 1, rng.randrange(5), sha, bits.to_bytes(32, "big") if rng.random() < 0.95 else None))
    return rows


def brute(rows):
    out = set()
    for i, b, s, h in rows:
        for j, c, t, g in rows:
            if c < b and ((s is not None and s == t) or (h is not None and g is not None and (int.from_bytes(h, "big") ^ int.from_bytes(g, "big")).bit_count() <= 16)):
                out.add((min(i, j), max(i, j)))
    return out


def test_against_double_loop(spark):
    rows = make()
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:20]] + [(None, 1, b"a", None, "x"), (900, None, b"a", None, "x")], SCHEMA + ", key string")
    got = [tuple(r) for r in batches.find_duplicates(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_probes_that_go_to_the_filters_and_large_classes_change_nothing(spark, monkeypatch):
    for name, value in (("SENT_FILTERS", 0), ("BLOOM_KEYS", 300), ("GENERATIONS", 2), ("CLASS_PART", 5)):
        monkeypatch.setattr(batches, name, value)
    rows = make(7)
    same = [(k, k % 4, bytes([7] * 32), (12345).to_bytes(32, "big")) for k in range(1000, 1040)]
    assert {tuple(r) for r in batches.find_duplicates(spark.createDataFrame(rows + same, SCHEMA)).collect()} == brute(rows + same)


def test_store_keeps_what_it_accepted(spark, tmp_path):
    """Another session opens the store for each batch; an accept that did not come to its end leaves nothing."""
    rows = make(6)
    found = set()
    for number in range(5):
        own = [r for r in rows if r[1] == number]
        batch = spark.createDataFrame(own, SCHEMA)
        store = batches.FingerprintStore(spark, str(tmp_path))
        for kind, new, old, _ in (tuple(r) for r in store.screen(batch).collect()):
            value = {r[0]: r[2 + (kind == 0)] for r in rows}
            found |= {(min(a[0], b[0]), max(a[0], b[0])) for a in own for b in rows if b[1] < number and a[2 + (kind == 0)] == value[new] and b[2 + (kind == 0)] == value[old]}
        store._write("g99", batches.batch_classes(batch), 1)
        if number == 3:
            store.compact()
        store.accept(batch)
        with __import__("pytest").raises(OSError):
            store._commit(store._state)
    assert found == brute(rows) and len(store._state["generations"]) == 3


def test_empty_and_unreadable(spark):
    assert batches.find_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    raw = spark.createDataFrame([(1, None, None, "x"), (2, "", "", "x"), (3, "ab", "0" * 64, "x"), (4, "ab", "A" * 43 + "=", "x")], "id bigint, sha256_hash string, perceptual_hash string, bits string")
    from pyspark.sql import functions as F

    assert batches.find_duplicates(batches.records(raw, F.col("id"))).count() == 0
