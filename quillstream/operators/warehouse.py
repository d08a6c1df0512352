"""The warehouse side: latest versions, replaced child sets, deletions, checks.

No table format with MERGE is assumed: each function gives the new state of a
table as a frame, and ``swapped`` writes it beside the old one before the two
change places.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """The row of the highest ``order`` of each key, ties decided by the other columns.

    An aggregate, not a window: versions are combined before they are shuffled,
    so a key with many of them is no hot spot.
    """
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    rest = [c for c in df.columns if c not in order]
    rows = df.select(*named, F.struct(*order, *rest).alias("_v"))
    return rows.groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.max("_v").alias("_v")).select(*(F.col("_v")[c].alias(c) for c in df.columns))


def upserted(target: DataFrame, changes: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """Target and changes with the latest version of each key."""
    return latest(target.unionByName(changes, allowMissingColumns=True), keys, order)


def children_replaced(target: DataFrame, delivered: DataFrame, parents: list[str]) -> DataFrame:
    """The child set of every delivered parent takes the place of the one it had."""
    again = delivered.select(*parents).distinct()
    return target.join(again, parents, "left_anti").unionByName(delivered)


def snapshot_replaced(target: DataFrame, delivered: DataFrame, scope: list[str]) -> DataFrame:
    """All rows of the scopes delivered are replaced."""
    return children_replaced(target, delivered, scope)


def swept(headers: DataFrame, manifest: DataFrame, start: str, end: str) -> DataFrame:
    """Marks the headers of a window that the manifest lacks as deleted; nothing is removed."""
    there = manifest.select(F.lower("guid").alias("_guid")).distinct().withColumn("_there", F.lit(True))
    inside = F.col("voucher_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    joined = headers.withColumn("_guid", F.lower("guid")).join(there, "_guid", "left")
    gone = inside & F.col("_there").isNull()
    return joined.withColumn("is_deleted", F.coalesce(gone, F.lit(False)) | F.col("is_deleted")).withColumn("source_status", F.when(gone, "deleted").otherwise(F.col("source_status"))).drop("_guid", "_there")


def compared(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Values of both sides by key with their difference, where they are not the same; a missing side counts as 0."""
    a = left.select(*keys, *(F.col(v).alias(f"{v}_source") for v in values))
    b = right.select(*keys, *(F.col(v).alias(f"{v}_target") for v in values))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = a.join(b, keys, "full").select(*keys, *(zero(f"{v}_{s}") for v in values for s in ("source", "target")))
    out = both.select("*", *((F.col(f"{v}_source") - F.col(f"{v}_target")).alias(f"{v}_diff") for v in values))
    return out.filter(" or ".join(f"{v}_diff <> 0" for v in values))


def swapped(df: DataFrame, path: str) -> None:
    """Writes a table's new state beside it, then puts it in its place.

    Reading the old state while writing over it would lose it; the old one is
    kept until the new one is there. ``recovered`` undoes a swap that was cut
    off between the two renames, and is called first.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    recovered(spark, path)
    made = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(made)
    new, old, back = (jvm.org.apache.hadoop.fs.Path(p) for p in (made, path, f"{path}.old"))
    fs = old.getFileSystem(conf)
    if fs.exists(old):
        fs.rename(old, back)
    fs.rename(new, old)
    fs.delete(back, True)


def recovered(spark: SparkSession, path: str) -> None:
    """Puts the old state of a table back if a swap left none in its place, and removes it if the new one is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, back = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.old"))
    fs = here.getFileSystem(conf)
    if fs.exists(back):
        if fs.exists(here):
            fs.delete(back, True)
        else:
            fs.rename(back, here)
