import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from quillstream.session import local_session

    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data() -> str:
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


def duck(folder) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def rows_of(columns, rows) -> list[tuple]:
    """Rows by sorted column names, with numbers and nulls made comparable."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def one(v) -> str:
        if v is None or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[k]) for k in order) for r in rows)


def same(df, con, sql: str) -> None:
    """Asserts that a frame and a query give the same rows under the same names."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    assert got == want, (len(got), len(want), [r for r in got if r not in want][:3], [r for r in want if r not in got][:3])
