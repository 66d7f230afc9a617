"""The driver's contract."""

import __spark_entry__ as contract


def test_names():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 100
    assert all(callable(q) for q in queries.values())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["i0", "i1", "v"] and df.count() == 64 * 64
