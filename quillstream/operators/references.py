"""References to records that do not exist, or not yet, or no more.

Parent keys are turned into integers without loss (``serial``): a key is its
stem and the number its last hexadecimal digits write, of a known width. Sorted
keys of consecutive numbers that are live from the same time are compressed into
runs. Each distinct referenced key is matched as of the run that starts at or
before it; a key beyond that run's end has no parent. Names that end in no digit
are runs of one key. Runs and references meet within (stem, width, block of numbers), which
holds ``BLOCK`` keys at most, and references are combined to one row a key
before they are shuffled: a hot key weighs nothing until the last step, where
its rows are spread by salt or met by a broadcast of checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.session import cut, lookup_join

#: Numbers per block; no run crosses a block.
BLOCK = 4096
#: Hexadecimal digits read into the number at most, so that it fits 63 bits.
DIGITS = 15


def serial(key: Column) -> list[Column]:
    """``stem``, ``width`` and ``number`` of a key in lower case; together they give it back."""
    tail = F.regexp_extract(key, rf"([0-9a-f]{{1,{DIGITS}}})$", 1)
    width = F.length(tail)
    return [F.left(key, F.length(key) - width).alias("stem"), width.alias("width"), F.coalesce(F.conv(tail, 16, 10).try_cast("bigint"), F.lit(0)).alias("number")]


def runs_of(parents: DataFrame) -> DataFrame:
    """From target, key and live_from (one row a key): target, stem, width, block, lo, hi, live_from.

    A run holds keys of consecutive numbers that are live from the same time, so
    that it is three values however many keys it holds.
    """
    keyed = parents.select("target", *serial(F.col("key")), "live_from").withColumn("block", F.floor(F.col("number") / BLOCK))
    by = ["target", "stem", "width", "block"]
    w = Window.partitionBy(*by).orderBy("number")
    goes_on = (F.col("number") == F.lag("number").over(w) + 1) & F.col("live_from").eqNullSafe(F.lag("live_from").over(w))
    grouped = keyed.withColumn("opens", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("opens").over(w)).groupBy(*by, "island")
    return grouped.agg(F.min("number").alias("lo"), F.max("number").alias("hi"), F.min("live_from").alias("live_from")).drop("island")


def faulty_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The referenced keys that lack a parent, or lacked it when first referred to.

    ``references``: target, key, at. ``parents``: target, key, live_from, unique
    by target and key. Result: target, key, live_from (null: there is none).
    """
    distinct = references.groupBy("target", "key").agg(F.min("at").alias("first_at"))
    by = ["target", "stem", "width", "block"]
    asked = distinct.select("target", *serial(F.col("key")), "key", "first_at").withColumn("block", F.floor(F.col("number") / BLOCK))
    runs = runs_of(parents).select(*by, F.col("lo").alias("number"), F.struct("hi", "live_from").alias("run"))
    w = Window.partitionBy(*by).orderBy("number", F.col("key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    matched = asked.unionByName(runs, allowMissingColumns=True).withColumn("run", F.last("run", ignorenulls=True).over(w)).filter("key is not null")
    inside = F.coalesce(F.col("run.hi") >= F.col("number"), F.lit(False))
    return matched.select("target", "key", "first_at", (~inside).alias("missing"), F.when(inside, F.col("run.live_from")).alias("live_from")).filter("missing or first_at < live_from").select("target", "key", "live_from")


def orphans(references: DataFrame, parents: DataFrame, unique: str) -> DataFrame:
    """The rows of ``references`` whose key has no parent that was live at ``at``.

    ``references``: target, key, at, ``unique`` (spreads hot keys) and any other
    columns, all of which come out. Null keys refer to nothing. A parent with a
    null live_from was always there; a reference with a null ``at`` is only an
    orphan if the parent is missing altogether. Repeated rows each come out.
    """
    references = references.filter("key is not null")
    faulty = cut(faulty_keys(references, parents.filter("key is not null")).withColumnRenamed("live_from", "_live_from"))
    found = lookup_join(references, faulty, ["target", "key"], salt_by=unique)
    return found.filter("_live_from is null or at < _live_from").drop("_live_from")
