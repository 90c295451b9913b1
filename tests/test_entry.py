import __spark_entry__ as e


def test_registry(spark):
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    assert e.entry(spark).count() > 0
