"""Every query with SQL gives what DuckDB gives; the rest run."""

import pytest

from quarryline import plans
from tests.compare import DATA, check, connect

QUERIES, SQL = plans.queries(), plans.sql()
con = connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    check(QUERIES[name](spark, DATA), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns
    df.count()


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
