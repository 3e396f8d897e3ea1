"""Every registered query against its SQL on the smallest scale."""
import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
ORACLES = oracle_sql()
# The whole profiles repeat the checks of their parts; check_queries.py runs them too.
NAMES = [n for n in queries() if not n.startswith("profile_")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    _, n, problems = compare(spark, con, name, queries()[name], ORACLES.get(name), FOLDER)
    assert not problems
    assert n > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["instance_id", "category_id"]
    assert df.count() > 0
