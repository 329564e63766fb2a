"""Where operators register the queries that show them on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattmill.operators.views import VIEWS, Plant

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The same functions, for a plant of one's own.
BY_PLANT: dict[str, Callable[[Plant], DataFrame]] = {}


def query(name: str, sql: str | None = None, base: str = VIEWS):
    """Registers a function of a `Plant`. `sql` is the oracle behind the common table expressions of `base`."""

    def register(f: Callable[[Plant], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Plant(spark, sf_dir))
        BY_PLANT[name] = f
        if sql is not None:
            ORACLES[name] = base + ("\n" if sql.lstrip().upper().startswith("SELECT") or not base else ",\n") + sql
        return f

    return register
