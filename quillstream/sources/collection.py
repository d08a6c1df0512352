"""Scans of landed collections: the columns asked for, the period asked for, no more.

Collections are landed in folders by month, so a period prunes folders, and a
column list reaches the scan as its read schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def land(df: DataFrame, path: str, day: str, mode: str = "append") -> None:
    """Writes rows into folders by the month of ``day``; rows without a day go to the default folder."""
    df.withColumn("_month", F.date_format(day, "yyyy-MM")).write.mode(mode).partitionBy("_month").parquet(path)


def land_again(df: DataFrame, path: str, day: str) -> None:
    """Replaces just the months that ``df`` has rows of."""
    df.withColumn("_month", F.date_format(day, "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_month").parquet(path)


def scan(spark: SparkSession, path: str, fields: list[str], day: str | None = None, start: str | None = None, end: str | None = None, company: str | None = None) -> DataFrame:
    """The named columns of the rows of a period (both days belong to it) and company."""
    df = spark.read.option("basePath", path).parquet(path)
    df = df.withColumn("_month", F.col("_month").cast("string"))
    if start:
        df = df.filter((F.col("_month") >= start[:7]) & (F.col(day) >= F.lit(start).cast("date")))
    if end:
        df = df.filter((F.col("_month") <= end[:7]) & (F.col(day) <= F.lit(end).cast("date")))
    if company:
        df = df.filter(F.col("_company") == company)
    return df.select(*fields)


def highest(spark: SparkSession, path: str, column: str = "alter_id") -> int | None:
    """The change mark of a collection."""
    return scan(spark, path, [column]).agg(F.max(column)).first()[0]
