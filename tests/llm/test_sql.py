import pytest

from casemill.llm import queries
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    at = "/root/testdata/sf0.001"
    assert spark_rows(spark, queries.QUERIES[name], at) == duck_rows(queries.SQL[name], at)
