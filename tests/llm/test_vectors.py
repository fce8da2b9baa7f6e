"""Most similar vectors and clusters against plain double loops."""

import numpy as np

from heliograph.llm import linkage, vectors

SCHEMA = "kind string, id bigint, vector array<float>, u string"


def clustered(rng, sizes, dims=128, noise=0.35):
    rows = []
    for size in sizes:
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            x = centre + noise * rng.normal(size=dims) / np.sqrt(dims)
            rows.append(x * rng.uniform(0.1, 20))
    return np.array(rows, np.float32)


def brute(ids, rows, least, k):
    x = rows.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[i, j] >= least}
    return out


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = clustered(rng, [1, 2, 3, 40, 9, 1, 1, 25])
    rows = np.concatenate([rows, rows[[3] * 9], rows[[50]]])  # exact copies, more than k of one
    ids = rng.permutation(len(rows)) + 1
    bad = [(1000, None), (1001, []), (1002, [0.0] * 128), (1003, [float("nan")] + [1.0] * 127), (1004, [1.0] * 64), (1005, [None] + [1.0] * 127), (None, [1.0] * 128), (1006, [float("inf")] * 128)]
    data = [("a", int(i), r.tolist(), "clash") for i, r in zip(ids, rows, strict=True)]
    data += data[:5] + [("a", i, v, "clash") for i, v in bad] + [("b", 1, rows[0].tolist(), "clash"), ("b", 2, rows[0].tolist(), "clash")]
    df = spark.createDataFrame(data, SCHEMA)
    expected = brute(ids.tolist(), rows, 0.8, 5)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    for group in (10_000, 30):
        monkeypatch.setattr(vectors, "GROUP", group)
        monkeypatch.setattr(vectors.similar_pairs, "__defaults__", (128, group, 6))
        got = {(r["kind"], r["id_a"], r["id_b"]) for r in vectors.neighbours(df, 0.8, 5).collect()}
        assert {(a, b) for k, a, b in got if k == "a"} == expected
        assert {(a, b) for k, a, b in got if k == "b"} == {(1, 2)}


def test_tiles_keep_the_best_under_bounds():
    rng = np.random.default_rng(1)
    rows = clustered(rng, [300, 5, 5], noise=0.8)
    u = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    side = vectors._Side(np.arange(len(u)), u, np.zeros(len(u), np.int32))
    heap, _ = vectors._tiles(side, side, True, 0.3, 4, 6)
    at, _, partner = heap.prune()
    got = {(min(side.ids[a], p), max(side.ids[a], p)) for a, p in zip(at, partner, strict=True)}
    assert got == brute(list(range(len(u))), rows, 0.3, 4)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.neighbours(empty, 0.8, 5).count() == 0
    member, clusters = linkage.cluster(empty.select("id", "vector"))
    assert member.count() == 0 and clusters.count() == 0


def test_clusters(spark):
    rng = np.random.default_rng(2)
    sizes = [1, 2, 3, 60, 9, 1, 30, 17]
    rows = clustered(rng, sizes, noise=0.4)
    ids = rng.permutation(len(rows)) + 1
    truth, at = {}, 0
    for size in sizes:
        own = ids[at : at + size]
        truth |= {int(i): int(own.min()) for i in own}
        at += size
    data = [(int(i), r.tolist()) for i, r in zip(ids, rows, strict=True)] + [(900, None), (901, [0.0] * 128), (None, [1.0] * 128)]
    df = spark.createDataFrame(data + data[:3], "id bigint, vector array<float>")
    member, clusters = linkage.cluster(df)
    assert {r["id"]: r["cluster"] for r in member.collect()} == truth
    described = {r["cluster"]: r for r in linkage.describe(df, member, clusters).collect()}
    for key, row in described.items():
        own = [i for i, c in truth.items() if c == key]
        assert row["size"] == len(own) and row["representative"] == row["typical"][0] and set(row["typical"]) <= set(own) and len(row["typical"]) == min(3, len(own))


def sequential(x, least):
    """Groups of average linkage that merges the best pair of all, one after the other."""
    groups = [[i] for i in range(len(x))]
    s = x @ x.T
    while len(groups) > 1:
        best = max((np.mean(s[np.ix_(a, b)]), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] < least:
            break
        groups[-best[1]] += groups.pop(-best[2])
    return sorted(map(sorted, groups))


def overlapping(seed, n=70):
    """Vectors along a few arcs, so that sets run into each other and no clear gap ends them."""
    rng = np.random.default_rng(seed)
    ends = rng.normal(size=(5, 128))
    at = rng.uniform(0, 4, size=n)
    x = np.array([ends[int(t)] * (1 - t % 1) + ends[int(t) + 1] * (t % 1) for t in at]) + 0.25 * rng.normal(size=(n, 128))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_merging_equals_sequential_average_linkage():
    for seed in range(6):
        x = overlapping(seed) if seed % 2 else clustered(np.random.default_rng(seed), [4, 7, 2, 5, 1], noise=0.5)
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        head, n, _ = linkage.merge_reciprocal(np.arange(len(x)), np.ones(len(x), np.int64), x, 0.7)
        assert sequential(x.astype(np.float64), 0.7) == sorted(sorted(np.flatnonzero(head == h).tolist()) for h in set(head))
        assert all(n[h] == (head == h).sum() for h in set(head))


def agreement(groups, others):
    """Share of the pairs of one group in either that are so in both."""
    pairs = [{(i, j) for own in g for i in own for j in own if i < j} for g in (groups, others)]
    return len(pairs[0] & pairs[1]) / max(1, len(pairs[0] | pairs[1]))


def test_clusters_of_overlapping_sets_equal_sequential_average_linkage(spark, monkeypatch):
    """Groups are small, and a third of the rows are copies of one vector; components too large for a task agree nearly."""
    monkeypatch.setattr(vectors.similar_pairs, "__defaults__", (128, 20, 6))
    x = overlapping(11)
    x = np.concatenate([x, x[[4] * 35]])
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id bigint, vector array<float>")
    for part in (linkage.PART, 24):
        monkeypatch.setattr(linkage, "PART", part)
        member, clusters = linkage.cluster(df)
        found = {}
        for r in member.collect():
            found.setdefault(r["cluster"], []).append(r["id"])
        if part > len(x):
            assert sorted(map(sorted, found.values())) == sequential(x.astype(np.float64), 0.7)
        assert agreement(found.values(), sequential(x.astype(np.float64), 0.7)) > 0.7
        assert {r["cluster"]: r["size"] for r in clusters.collect()} == {k: len(v) for k, v in found.items()} and all(k == min(v) for k, v in found.items())
        means = np.array([x[v].astype(np.float64).mean(axis=0) for v in found.values()])
        assert (means @ means.T)[~np.eye(len(means), dtype=bool)].max() < 0.7


def test_cells_out_of_reach_are_not_sent():
    centres = np.eye(4, 128, dtype=np.float32)
    near = [(k, 10, 0.1, 1.0) for k in range(4)]
    assert {(p, g, h) for p, _, _, g, h in vectors._targets(near, centres, 4, 0.8)} == {(p, g, g) for p, _, _, g, _ in vectors._targets(near, centres, 4, 0.8)}
    wide = [(k, 10, 1.3, 1.0) for k in range(4)]
    assert len(vectors._targets(wide, centres, 4, 0.8)) == 16
    parts = vectors._targets([(0, 90, 0.1, 1.0), (1, 10, 0.1, 1.0)], centres, 4, 0.8)
    assert {(p, part) for p, part, *_ in parts} == {(0, k) for k in range(4)} | {(1, 0)} and all((0, k, 4, g, h) in parts for k, g in ((r[1], r[3]) for r in parts if r[0] == 0) for h in {r[3] for r in parts if r[0] == 0})


def test_vectors_move_once_whatever_the_number_of_groups(spark):
    """400 vectors without neighbours in 20 groups; the shuffles hold each vector about once, not once a group."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(400, 128)).astype(np.float32)
    rows = np.concatenate([rows, rows[:40] + np.float32(0.01)])
    df = spark.createDataFrame([("a", k, r.tolist()) for k, r in enumerate(rows)], "kind string, id bigint, vector array<float>")
    units = vectors.units(df, 128).selectExpr("'a' AS kind", "id", "u").localCheckpoint()
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    found = vectors.similar_pairs(units, 0.8, 5, 128, 22).collect()
    assert {(r["id"], r["partner"]) for r in found} == {p for k in range(40) for p in ((k, 400 + k), (400 + k, k))}
    assert written() - before < 3 * rows.nbytes


def test_clusters_do_not_depend_on_the_size_of_the_input(spark, monkeypatch):
    """Sets that run into each other are clustered as the sequential method does, alone and among many others, whatever ``PART`` is."""
    monkeypatch.setattr(vectors.similar_pairs, "__defaults__", (128, 40, 6))
    x = overlapping(11)
    more = np.random.default_rng(6).normal(size=(60, 128)).astype(np.float32)
    expected = sequential(x.astype(np.float64), 0.7)
    for part, rows in ((2048, x), (8, x), (8, np.concatenate([x, more]))):
        monkeypatch.setattr(linkage, "PART", part)
        member, _ = linkage.cluster(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "id bigint, vector array<float>"))
        found = {}
        for r in member.where("id < 70").collect():
            found.setdefault(r["cluster"], []).append(r["id"])
        assert sorted(map(sorted, found.values())) == expected
