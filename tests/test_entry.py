import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["project", "cuts", "removed", "kept_length"] and rows.count() > 0
