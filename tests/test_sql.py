"""Queries against their SQL in DuckDB on the smallest tables."""

import glob
from pathlib import Path

import pytest

ROOT = "/root/testdata/sf0.001"
NAMES = ["c7_metadata", "c8_rotation", "e11_exact_duplicates", "e12_smart_albums", "f5_word_search", "f10_keep_best", "f15_leader_clusters", "g22_find_or_create", "h5_changes", "h7_retention", "p6_found", "p6_near", "f7_perceptual_groups", "f8_duplicate_report", "d12_similar_hashes", "j3_rename", "i5_filenames", "i7_organise", "f18_suppress_boxes", "b2_json_rows", "b4_html", "c12_old_trashed"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    from heliograph.plans import registry

    df = registry.QUERIES[name](spark, ROOT)
    columns = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted((tuple(map(plain, r)) for r in expected), key=key)
