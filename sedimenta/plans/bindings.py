"""Registered queries over the test tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bronze, dims, entity_runs, facts, monitor, silver, verify

SECTIONS = (bronze, silver, entity_runs, dims, facts, verify, monitor)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for s in SECTIONS for k, v in s.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for s in SECTIONS for k, v in s.ORACLE_SQL.items()}
