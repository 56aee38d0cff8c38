"""All queries of this part of the library, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans import lifecycle_queries, pattern_queries, rule_queries, storage_queries, table_queries, view_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**pattern_queries.QUERIES, **table_queries.QUERIES, **lifecycle_queries.QUERIES, **view_queries.QUERIES, **storage_queries.QUERIES, **rule_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**pattern_queries.ORACLE_SQL, **table_queries.ORACLE_SQL, **lifecycle_queries.ORACLE_SQL, **view_queries.ORACLE_SQL, **storage_queries.ORACLE_SQL, **rule_queries.ORACLE_SQL}
