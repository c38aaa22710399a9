"""Every network query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as network_queries
from .plans import rule_queries, tag_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return network_queries.QUERIES | tag_queries.QUERIES | rule_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return network_queries.SQL | tag_queries.SQL | rule_queries.SQL
