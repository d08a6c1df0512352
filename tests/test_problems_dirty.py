"""Problems 1 to 6 over tables made worse: null rows, repeated rows, clashing extra columns; and over empty ones."""

import pytest
from conftest import duck, same

from quillstream.plans import problems

TABLES = ["upload_batches", "cost_centres", "voucher_types", "sync_checkpoints", "raw_messages", "bank_book", "bill_allocations", "voucher_headers", "ledgers"]
CLASH = ["k0", "lo", "hi", "shard", "run", "day", "key", "target", "at", "live_from", "number", "stem", "id", "scope", "tree", "node", "component", "state", "v", "w", "_salt"]


def _copied(data, folder, select):
    con = duck(data)
    for t in TABLES:
        con.execute(f"copy ({select(t, con)}) to '{folder}/{t}.parquet' (format parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def worse(data, tmp_path_factory):
    def select(t, con):
        names = [c[0] for c in con.execute(f"select * from {t} limit 0").description]
        extra = ", ".join(f"'x' as {c}" for c in CLASH if c not in names)
        nulls = ", ".join(f"null as {c}" for c in names)
        repeated = f"select * from {t} where hash({names[0]}) % 5 = 0"
        return f"select *, {extra} from (select * from {t} union all {repeated} union all select {nulls})"

    return _copied(data, tmp_path_factory.mktemp("worse"), select)


@pytest.fixture(scope="module")
def empty(data, tmp_path_factory):
    return _copied(data, tmp_path_factory.mktemp("empty"), lambda t, con: f"select * from {t} limit 0")


@pytest.mark.parametrize("name", sorted(problems.oracle_sql()))
def test_worse_tables(spark, worse, name):
    same(problems.queries()[name](spark, worse), duck(worse), problems.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(problems.queries()))
def test_empty_tables(spark, empty, name):
    assert problems.queries()[name](spark, empty).collect() == []
