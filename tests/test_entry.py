import __spark_entry__ as entry


def test_entry(spark, tables):
    found = entry.entry(spark)
    assert found.columns == ["query_id", "context", "n"] and found.count() >= 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_a_library_the_core_stays(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError("No module named 'regex'", name="regex")

    monkeypatch.setattr(entry, "import_module", missing)
    assert "hybrid_search" in entry.queries() and not any(n.startswith("p1_") for n in entry.queries())
