"""Every query with SQL against DuckDB, on tables with a second copy under large keys; every other one runs and has a stable schema."""

import pytest

from compare import SF, connection, doubled, same
from speechframe.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    return doubled(SF, tmp_path_factory.mktemp("doubled"))


@pytest.fixture(scope="module")
def duck(tables):
    return connection(tables)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, tables, name):
    same(QUERIES[name](spark, tables), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
