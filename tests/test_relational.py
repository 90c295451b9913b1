import pytest
from oracle import both

from seamark.operators import relational


@pytest.mark.parametrize("name", sorted(relational.QUERIES))
def test_query_equals_sql(spark, name):
    got, want = both(spark, "/root/testdata/sf0.001", relational.QUERIES[name], relational.ORACLE[name])
    assert got == want
