"""Overlapping and gapped intervals: unbroken periods and the gaps between them.

Two levels. Each interval is clipped into time shards, so one entity's days are
spread over many tasks; within (entity, shard, first day) only the furthest end
is kept, which the map side already combines, so a shard never holds more rows
than it has days, however many intervals an entity has. Each shard is merged by
itself. Only coverage that touches a shard's edge is stitched in a second pass,
where an entity has two rows a shard at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_DAYS = 366


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, shard_days: int = SHARD_DAYS) -> DataFrame:
    """Columns: keys, span_kind (``period`` or ``gap``), day_from, day_to (dates).

    ``start`` and ``end`` are date columns; both days belong to the interval.
    Rows with a null bound or start after end are left out. Null keys form an
    entity of their own. Repeated rows change nothing; an empty table gives an
    empty one. Other columns of ``df`` are ignored, whatever their names.
    """
    names = [f"k{i}" for i in range(len(keys))]
    days = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.unix_date(start).alias("a"), F.unix_date(end).alias("b")).filter("a <= b")
    size = F.lit(shard_days)
    pieces = days.withColumn("shard", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor(F.col("b") / size))))
    first, last = F.col("shard") * size, F.col("shard") * size + (size - 1)
    clipped = pieces.groupBy(*names, "shard", F.greatest("a", first).alias("lo")).agg(F.max(F.least("b", last)).alias("hi"))

    local = _runs(clipped, [*names, "shard"])
    # what touches an edge of its shard shares one stitching group; the rest is final
    local = local.withColumn("part", F.when((F.col("lo") > first) & (F.col("hi") < last), F.col("shard")))
    periods = _runs(local.drop("shard"), [*names, "part"]).drop("part")

    following = F.lead("lo").over(Window.partitionBy(*names).orderBy("lo"))
    spans = periods.withColumn("next_lo", following).select(
        *names,
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("span_kind"), F.col("lo"), F.col("hi")),
                    F.struct(F.lit("gap").alias("span_kind"), (F.col("hi") + 1).alias("lo"), (F.col("next_lo") - 1).alias("hi")),
                ),
                lambda s: s["hi"].isNotNull(),
            )
        ),
    )
    return spans.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), "span_kind", F.date_from_unix_date("lo").alias("day_from"), F.date_from_unix_date("hi").alias("day_to"))


def _runs(df: DataFrame, by: list[str]) -> DataFrame:
    """Merges the stretches lo..hi of each group that overlap or touch."""
    w = Window.partitionBy(*by).orderBy("lo")
    reached = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("lo") <= reached + 1, 0).otherwise(1)
    return df.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w)).groupBy(*by, "run").agg(F.min("lo").cast("int").alias("lo"), F.max("hi").cast("int").alias("hi")).drop("run")
