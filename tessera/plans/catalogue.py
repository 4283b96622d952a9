"""Named queries over the driver tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data_queries, file_queries, snapshot_queries, store_queries, stream_queries, vault_queries

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (snapshot_queries, data_queries, vault_queries, stream_queries, store_queries, file_queries)


def queries() -> dict[str, Query]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
