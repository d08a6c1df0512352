"""Totals and averages over trailing periods, days without activity included.

Event-contribution deltas: a day's amount is added on its day and taken off
again when it leaves the window, so one running sum per window length gives
every trailing total without a range frame. Rows are combined to one per entity
and day before they are shuffled by entity: the running sum of an entity, hot
or not, is no longer than its calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import cents


def unrepeated(df: DataFrame, ignore: list[str], keep: list[str]) -> DataFrame:
    """The rows of ``df`` that differ in some column outside ``ignore``, with the columns ``keep``.

    Only ``keep`` and a 128-bit hash of the remaining columns (with a mask of
    their nulls) are shuffled.
    """
    rest = [c for c in df.columns if c not in ignore and c not in keep]
    cols = [F.col(f"`{c}`") for c in rest]
    nulls = F.concat(F.lit(""), *(F.isnull(c).cast("int").cast("string") for c in cols))
    hashes = [F.xxhash64(F.lit(salt), nulls, *cols).alias(f"_h{salt}") for salt in (1, 2)]
    return df.select(*keep, *hashes).groupBy(*keep, "_h1", "_h2").agg(F.lit(1).alias("_n")).select(*keep)


def trailing_runs(df: DataFrame, keys: list[str], day: str, amounts: list[str], lengths: list[int]) -> DataFrame:
    """Stretches of days on which all trailing totals stay the same.

    Columns: keys, first_day, last_day (of the entity), run_from, run_to and
    ``{amount}_{length}`` for each amount and window length. Rows with a null
    day are left out; null amounts count as 0; null keys are an entity. An
    entity's calendar goes from its first to its last day.
    """
    names = [f"k{i}" for i in range(len(keys))]
    daily = (
        df.filter(F.col(day).isNotNull())
        .groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.unix_date(day).alias("day"))
        .agg(*(F.sum(cents(a)).alias(f"a{i}") for i, a in enumerate(amounts)))
    )
    zero = F.lit(0).cast("decimal(28,2)")
    sums = [(i, n) for i in range(len(amounts)) for n in lengths]

    def event(day_at: Column, leaves: int | None, real: bool) -> Column:
        deltas = [(F.col(f"a{i}") if real else -F.col(f"a{i}") if n == leaves else zero).cast("decimal(28,2)").alias(f"d{i}_{n}") for i, n in sums]
        return F.struct(day_at.alias("day"), F.lit(real).alias("real"), *deltas)

    # an entity has a row a day at most by now: laid together here, its deltas need no further shuffle
    events = daily.repartition(*names).select(*names, F.inline(F.array(event(F.col("day"), None, True), *(event(F.col("day") + n, n, False) for n in lengths))))
    changes = events.groupBy(*names, "day").agg(F.max("real").alias("real"), *(F.sum(f"d{i}_{n}").alias(f"d{i}_{n}") for i, n in sums))
    whole = Window.partitionBy(*names)
    w = whole.orderBy("day")
    running = [F.sum(f"d{i}_{n}").over(w).alias(f"{amounts[i]}_{n}") for i, n in sums]
    runs = changes.select(
        *names,
        "day",
        F.min("day").over(whole).alias("first_day"),
        F.max(F.when(F.col("real"), F.col("day"))).over(whole).alias("last_day"),
        F.lead("day").over(w).alias("next_day"),
        *running,
    ).filter("day <= last_day")
    return runs.select(
        *(F.col(n).alias(k) for k, n in zip(keys, names)),
        *(F.date_from_unix_date(c).alias(c) for c in ("first_day", "last_day")),
        F.date_from_unix_date("day").alias("run_from"),
        F.date_from_unix_date(F.least(F.col("next_day") - 1, F.col("last_day"))).alias("run_to"),
        *(F.col(f"{amounts[i]}_{n}") for i, n in sums),
    )


def each_day(runs: DataFrame, earliest: Column | None = None) -> DataFrame:
    """One row per day of each stretch, column ``day_on``, from ``earliest`` on where given."""
    start = F.greatest(F.col("run_from"), earliest) if earliest is not None else F.col("run_from")
    return runs.withColumn("_from", start).filter(F.col("_from") <= F.col("run_to")).withColumn("day_on", F.explode(F.sequence("_from", "run_to"))).drop("_from", "run_from", "run_to")
