"""The library's registered queries over the driver's tables, and the SQL that checks them.

The tables hold no tilesets, so each query derives tiles, cameras or frames from their rows, the same way in Spark and SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.queries import documents, earth, frames, grids, runtimes, streams, trees, values

MODULES = (grids, values, earth, trees, documents, frames, runtimes, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
