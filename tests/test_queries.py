"""Every registered query with SQL equals it on the smallest tables; the others return rows."""

import pytest

from casemill.plans import registry
from tests.oracle import duck_rows, spark_rows

registry.load()
AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = spark_rows(spark, registry.QUERIES[name], AT)
    if name in registry.SQL:
        assert got == duck_rows(registry.SQL[name], AT)
    else:
        assert got[1]
