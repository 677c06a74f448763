import pytest

from compare import connection, same
from compare import SF
from speechframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(QUERIES[name](spark, SF), connection(SF), ORACLE_SQL[name])
