"""Components against union-find."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from heliograph.llm.components import connected_components
from heliograph.llm.linking import photo_links, star


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def run(spark, edges):
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "a bigint, b bigint, v string")
    return {r["vertex"]: r["component"] for r in connected_components(df).collect()}


def test_paths_rings_trees_and_a_core(spark):
    rng = random.Random(1)
    edges, n = [], 0
    for length in (1, 2, 7, 33):
        edges += [(n + i, n + i + 1) for i in range(length)]
        n += length + 1
    for length in (3, 4, 21):
        edges += [(n + i, n + (i + 1) % length) for i in range(length)]
        n += length
    edges += [(n, n + i) for i in range(1, 40)]
    n += 40
    edges += [(n + i, n + rng.randrange(i)) for i in range(1, 80)]
    n += 80
    edges += [(n + rng.randrange(60), n + rng.randrange(60)) for _ in range(120)]
    n += 60
    edges += [(n + i, n + (i + 1) % 9) for i in range(9)] + [(n, n + 20), (n + 20, n + 21), (n + 3, n + 30)]
    names = list(range(n + 40))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    edges += edges[:10] + [(b, a) for a, b in edges[:10]] + [(5, 5), (None, 3), (3, None)]
    assert run(spark, edges) == union_find(edges)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
def test_any_graph(spark, edges):
    assert run(spark, edges) == union_find(edges)


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(1, 1), (None, None)]) == {}


def test_links(spark):
    import base64

    raw = bytes(range(32))
    photos = [(1, base64.b64encode(raw).decode()), (2, raw.hex()), (3, None), (4, "0" * 64), (5, "0" * 64), (6, "ERR"), (7, "ERR"), (8, None), (9, None)]
    scores = [(3, 10, 0.9), (8, 10, 80.0), (3, 10, 0.9), (9, 10, 0.79), (6, 10, None), (7, 10, float("nan")), (99, 11, 1.0), (1, 11, 100.0), (2, None, 0.9)]
    links = photo_links(spark.createDataFrame(scores, "photo_id bigint, group_id bigint, similarity_score double"), spark.createDataFrame(photos, "id bigint, perceptual_hash string"))
    got = {r["vertex"]: r["component"] for r in connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 99: 1, 3: 3, 8: 3}


def test_star_has_no_pairs(spark):
    members = spark.range(1000).selectExpr("1 AS k", "id AS m")
    assert star(members, "k", "m").count() == 999
