"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from terraprofile.plans.fixtures import TABLES
from tools.check import compare

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data_dir, duck):
    df = QUERIES[name](spark, data_dir)
    if name in CHECKS:
        result = compare(df, duck.sql(CHECKS[name]))
        assert result.startswith("ok") and "types" not in result, result
    else:
        assert df.count() >= 1


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
