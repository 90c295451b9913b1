"""Registry of the library's queries; the driver reads it through __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seamark.operators import relational
from seamark.plans import lineage_queries, structure_queries

FLAGSHIP = "graph_impact"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.QUERIES | lineage_queries.QUERIES | structure_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.ORACLE | lineage_queries.ORACLE | structure_queries.ORACLE
