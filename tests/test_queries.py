import pytest

from priceloom.plans import changes, families, more, registry, reports, search  # noqa: F401
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(same, name):
    same(registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count()


def test_entry_imports_whatever_is_there(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count()
