import pytest
from oracle import compare

from pagewright.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name])
