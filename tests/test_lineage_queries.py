import pytest
from oracle import both

from seamark.plans import lineage_queries


@pytest.mark.parametrize("name", sorted(lineage_queries.QUERIES))
def test_query_equals_sql(spark, name):
    got, want = both(spark, "/root/testdata/sf0.001", lineage_queries.QUERIES[name], lineage_queries.ORACLE[name])
    assert got == want
    assert got or name == "measure_forbidden"
