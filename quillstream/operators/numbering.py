"""Running sums and numbers over an order, without one task for the whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.session import cut, lookup_join


def running_sum(df: DataFrame, by: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows of ``by`` up to this one.

    ``bucket`` must rise with ``order``, which must be total. Sums of buckets are
    accumulated, and only a bucket is summed up within one task.
    """
    totals = df.groupBy(*by, bucket).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row a bucket
    before = cut(totals.select(*by, bucket, (F.sum("_sum").over(w.orderBy(bucket)) - F.col("_sum")).alias("_before")))
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn(out, F.sum(value).over(inner))
    return lookup_join(summed, before, [*by, bucket]).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def numbered(df: DataFrame, by: list[str], bucket: str, order: list[Column], out: str = "row_nr") -> DataFrame:
    """Adds ``out``, the number of each row within ``by`` from 0, by the same two levels."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), by, bucket, order, "_one", out).drop("_one").withColumn(out, F.col(out) - 1)
