import __spark_entry__ as entry


def test_entry_and_names(spark):
    found = entry.entry(spark)
    assert found.columns == ["new_id", "place", "id", "hits"] and found.count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
