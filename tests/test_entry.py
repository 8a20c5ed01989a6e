import __spark_entry__ as entry


def test_queries_have_sql():
    assert len(entry.queries()) >= 30 and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
