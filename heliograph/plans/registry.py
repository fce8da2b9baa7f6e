"""All queries of the core with their SQL, by name."""

from __future__ import annotations

from heliograph.plans import catalogue_queries, reference_queries

QUERIES = {**reference_queries.QUERIES, **catalogue_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**reference_queries.ORACLE_SQL, **catalogue_queries.ORACLE_SQL}
