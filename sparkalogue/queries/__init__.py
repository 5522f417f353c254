"""Registered queries by family, with the DuckDB statement that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cleaning, edits, fused, histories, indexes, listings, objects, pages, records, similarity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for family in (similarity, indexes, listings, objects, histories, pages, edits, records, fused, cleaning):
    QUERIES |= family.QUERIES
    ORACLE_SQL |= family.ORACLE_SQL
