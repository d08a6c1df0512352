"""Every query against its SQL over the smallest tables, whole tables both."""

import pytest
from conftest import duck, same

from quillstream.plans import catalog, problems

QUERIES = problems.queries() | catalog.queries()
SQL = problems.oracle_sql() | catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same(QUERIES[name](spark, data), duck(data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["src_table", "src_field", "month_of", "row_id"]
