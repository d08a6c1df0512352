"""What the query catalogues share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def iso(df: DataFrame) -> DataFrame:
    """Days as ISO text, as the sinks write them."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date"})


def iso_sql(sql: str, *columns: str) -> str:
    """The same for SQL: the named columns are days."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}) FROM ({sql})"


def literal(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants."""
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    """The same rows as a VALUES list under the same names."""

    def one(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"
