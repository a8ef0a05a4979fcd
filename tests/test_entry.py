import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["case_id", "tier", "ord", "id", "activation", "cost"] and df.count() > 0
