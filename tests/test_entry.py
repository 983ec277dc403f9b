import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_repository_imports_without_optional_parts():
    from emberwatch.plans import registry

    assert registry.QUERIES and not any(n.startswith("op") and n[2].isdigit() for n in registry.QUERIES)
