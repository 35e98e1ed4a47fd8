import __spark_entry__ as entry
from quillan import catalog


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_core_does_not_need_the_training_data_operators():
    import pathlib

    root = pathlib.Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
