import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import both

from seamark.llm import registry, sql


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_equals_sql(spark, name):
    got, want = both(spark, "/root/testdata/sf0.001", registry.queries()[name], sql.ORACLE[name])
    assert len(got) == len(want)
    assert got == want
