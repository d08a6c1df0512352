"""What changed between full snapshots of a table.

The kept snapshots of all deliveries are range-partitioned and sorted by key, so
each task holds every version of a contiguous range of keys side by side. One
streaming pass merges each snapshot with the one before: the row at hand and the
row before it are the two pointers; versions are compared column by column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import plain_or_null, stripped
from quillstream.session import lookup_join, stored


def deliveries(rows: DataFrame, company: str, run: str, at: str, complete: DataFrame) -> DataFrame:
    """The complete deliveries: company, run, rank (from 0), next_run, last_rank.

    ``complete`` has the columns company and run of the runs that are whole.
    Deliveries are ranked within the company by their earliest ``at``, ties by
    run. A run without rows is no delivery.
    """
    seen = rows.groupBy(F.col(company).alias("company"), F.col(run).alias("run")).agg(F.min(at).alias("at"))
    kept = seen.join(complete.select("company", "run").distinct(), ["company", "run"], "left_semi")
    w = Window.partitionBy("company").orderBy(F.col("at").asc_nulls_first(), "run")
    return kept.select("company", "run", (F.row_number().over(w) - 1).alias("rank"), F.lead("run").over(w).alias("next_run"))


def versions(rows: DataFrame, company: str, run: str, key: str, order: list[str], columns: list[str], kept: DataFrame) -> DataFrame:
    """One row per company, delivery and key: that of the highest ``order``.

    Columns: company, run, key (plain), rank, next_run and ``columns`` as they
    are. Rows with a blank key or of a delivery not in ``kept`` are left out.
    Rows that tie in ``order`` are decided by their values, so that the result
    doesn't depend on the order of rows.
    """
    value = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    named = rows.select(F.col(company).alias("company"), F.col(run).alias("run"), plain_or_null(key).alias("key"), value.alias("v")).filter("key is not null")
    # what isn't kept goes before anything is shuffled
    best = lookup_join(named, kept, ["company", "run"], salt_by="key").groupBy("company", "run", "key", "rank", "next_run").agg(F.max("v").alias("v"))
    return best.select("company", "run", "key", "rank", "next_run", *(F.col(f"v.c{i}").alias(c) for i, c in enumerate(columns)))


def changes(kept: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """From ``versions``: company, run (of the later snapshot), key and change_kind.

    ``added``, ``removed`` or ``changed``; the first snapshot gives nothing. Of
    ``texts`` spaces and tabs at the ends don't count and null is empty;
    ``numbers`` are compared with null equal to null.
    """
    by_key = kept.select(
        "company", "run", "key", "rank", "next_run",
        F.struct(*(F.col(c) for c in numbers), *(F.coalesce(stripped(c), F.lit("")).alias(c) for c in texts)).alias("state"),
    )
    # written first: the ranges are found from a sample, which would compute the versions once more
    merged = stored(by_key, "versions").repartitionByRange("company", "key")
    w = Window.partitionBy("company", "key").orderBy("rank")
    before, state_before, after = F.lag("rank").over(w), F.lag("state").over(w), F.lead("rank").over(w)
    pairs = merged.select("company", "run", "key", "rank", "next_run", "state", before.alias("before"), state_before.alias("state_before"), after.alias("after"))
    continues = F.col("before") == F.col("rank") - 1
    arrived = F.when(continues & ~F.col("state").eqNullSafe(F.col("state_before")), F.lit("changed")).when((F.col("rank") > 0) & ~F.coalesce(continues, F.lit(False)), F.lit("added"))
    left = F.when(F.col("next_run").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("rank") + 1)), F.lit("removed"))
    both = F.array(F.struct(F.col("run"), arrived.alias("change_kind")), F.struct(F.col("next_run").alias("run"), left.alias("change_kind")))
    return pairs.select("company", "key", F.inline(F.filter(both, lambda x: x["change_kind"].isNotNull()))).select("company", "run", "key", "change_kind")
