"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graphs, legal, retrieval


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return retrieval.QUERIES | graphs.QUERIES | legal.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | graphs.SQL | legal.SQL
