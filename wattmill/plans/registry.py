"""Named queries of the library and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattmill.operators import analyses, cleaning, features, hourly, quality, report, retrieval, semantic, warehouse  # noqa: F401  (each registers its queries)
from wattmill.plans.catalog import ORACLES, QUERIES
from wattmill.sources import queries as _sources  # noqa: F401
from wattmill.streaming import queries as _streaming  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """One entry per operator: (spark, folder of the tables) -> result."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The same results as DuckDB SQL over the driver's tables."""
    return dict(ORACLES)
