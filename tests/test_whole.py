"""Queries that do the whole of a job that another query does in part, against their SQL."""

import pytest
from test_sql import duck, test_query_equals_sql as check  # noqa: F401


@pytest.mark.parametrize("name", ["d13_similar_vectors", "f6_cascade", "f6_cascade_image", "f6_cascade_provider", "j1_ranks"])
def test_whole_query_equals_sql(spark, duck, name):  # noqa: F811
    check(spark, duck, name)
