"""Every registered query against its DuckDB oracle."""

import duckdb
import pytest

from tests.conftest import DATA, same
from wattmill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    same(registry.queries()[name](spark, DATA).toPandas(), duck.execute(registry.oracle_sql()[name]).df())


#: `test_operators` runs them and holds the booster against a plain one.
LONG = {"m06_boosted_trees", "m07_group_ablation"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - LONG))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
