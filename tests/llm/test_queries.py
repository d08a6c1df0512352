"""The registered queries over the smallest tables."""

import pytest
from conftest import duck, same

from quillstream.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    same(Q.queries()[name](spark, data), duck(data), Q.oracle_sql()[name])


def test_all_run(spark, data):
    for name, query in Q.queries().items():
        assert query(spark, data).columns, name
    assert Q.p9_kept(spark, data).count() + Q.p9_found(spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_registered():
    import __spark_entry__ as e

    assert set(Q.queries()) <= set(e.queries())
