"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.registry import register
from palimpsest.sources import tables as T


def query(name: str, sql: str | None = None):
    """Registers a query whose SQL may name the logical tables."""
    return register(name, None if sql is None else T.with_tables(sql))


def now():
    return F.lit(T.NOW).cast("timestamp")


NOW_SQL = f"TIMESTAMP '{T.NOW}'"
