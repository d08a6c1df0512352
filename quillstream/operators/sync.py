"""The state of a sync: change gates, checkpoints, coverage, and the queue's and runs' transitions.

State is small beside the data, but lives in tables of any size: each function
gives a table's new state as a frame, from an aggregate over what happened and
one join by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import scalars as S
from quillstream.functions.text import plain
from quillstream.plans.windows import DONE_MARKER
from quillstream.session import lookup_join

GATES = {"masters": "_alter_gate_masters", "vouchers": "_alter_gate_vouchers"}


# ------------------------------------------------------------------- gates


def gates(seen: DataFrame, checkpoints: DataFrame, incremental: bool = True) -> DataFrame:
    """company, run_masters, run_vouchers: which phases have something to do.

    ``seen``: company, masters and vouchers, the change marks of the source,
    null where they couldn't be read. The two marks are compared apart, each
    with the checkpoint of its gate. A mark that is unknown on either side, or
    a mode that isn't ``incremental``, lets the phase run. Companies match plain.
    """
    held = checkpoints.filter(F.col("dataset").isin(*GATES.values())).groupBy(plain(F.col("company")).alias("_c"))
    held = held.agg(*(F.max(F.when(F.col("dataset") == d, F.col("last_alter_id"))).alias(f"_{g}") for g, d in GATES.items()))
    both = lookup_join(seen.withColumn("_c", plain(F.col("company"))), held, ["_c"], "left")
    runs = lambda g: (F.lit(not incremental) | ~F.coalesce(F.col(g) == F.col(f"_{g}"), F.lit(False))).alias(f"run_{g}")
    return both.select("company", runs("masters"), runs("vouchers"))


def gates_committed(seen: DataFrame, outcomes: DataFrame, at: str) -> DataFrame:
    """The gates' checkpoints to store: both marks of each company none of whose datasets failed.

    ``outcomes``: company and failed, a row a dataset. A company without
    outcomes, or with an unknown mark, stores nothing.
    """
    clean = outcomes.groupBy("company").agg(F.count_if("failed").alias("_n")).filter("_n = 0").select("company")
    marks = F.array(*(F.struct(F.lit(d).alias("dataset"), F.col(g).alias("last_alter_id")) for g, d in GATES.items()))
    known = seen.filter("masters is not null and vouchers is not null")
    return lookup_join(known, clean, ["company"], "left_semi").select("company", F.inline(marks), F.lit(at).alias("last_success_utc"), F.lit(True).alias("full_sync_done"))


# ------------------------------------------------------------- checkpoints


def advanced(checkpoints: DataFrame, windows: DataFrame, today: Column) -> DataFrame:
    """dataset, company, last_from, last_to, marker and full_sync_done after ``windows`` were walked.

    ``checkpoints`` has the same columns, unique by dataset and company.
    ``windows``: dataset, company, window_from, window_to, target (the first day
    of a full walk, null for an increment), failed and, for snapshots, rows
    (null where empty ones are allowed). Failed windows and empty snapshots move
    nothing. A full walk keeps its lowest and highest day and is done when it
    reaches its target. An increment keeps its first day, takes the last one
    walked, and is done once that is ``today``. Where both are walked at once the
    full walk counts.
    """
    moved = windows.filter("not coalesce(failed, false) and (rows is null or rows > 0)").groupBy("dataset", "company")
    walk = moved.agg(F.min("window_from").alias("_from"), F.max("window_to").alias("_to"), F.max("target").alias("_target"))
    both = checkpoints.join(walk, ["dataset", "company"], "full")
    full = F.col("_target").isNotNull()
    low, high = F.least("last_from", "_from"), F.greatest("last_to", "_to")
    kept = F.col("_from").isNull() & F.col("_to").isNull()
    return both.select(
        "dataset", "company",
        F.when(kept, F.col("last_from")).when(full, low).otherwise(F.coalesce("last_from", "_from")).alias("last_from"),
        F.when(kept, F.col("last_to")).when(full, high).otherwise(F.col("_to")).alias("last_to"),
        F.when(~kept & full, F.lit(DONE_MARKER)).otherwise(F.col("marker")).cast("long").alias("marker"),
        F.when(kept, F.coalesce("full_sync_done", F.lit(False))).when(full, low <= F.col("_target")).otherwise(F.coalesce("full_sync_done", F.lit(False)) | (F.col("_to") >= today)).alias("full_sync_done"),
    )


def coverage(windows: DataFrame, run: Column, at: Column) -> DataFrame:
    """The evidence a run appends: dataset, company, window, rows, whether it was walked, by which run and when."""
    return windows.select("dataset", "company", "window_from", "window_to", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), (~F.coalesce("failed", F.lit(False))).alias("covered"), run.alias("sync_id"), at.alias("recorded_utc"))


# ------------------------------------------------------------- transitions


def changed(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """The table with ``values`` in the rows where ``where`` holds; an unknown ``where`` changes nothing."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def rescheduled(queue: DataFrame, failures: DataFrame) -> DataFrame:
    """Batches that failed for now: pending again, one more retry, due after their wait.

    ``failures``: batch_id (unique), error and next_attempt_utc.
    """
    f = failures.select("batch_id", F.lit(True).alias("_hit"), S.capped(F.col("error"), 2000).alias("_error"), F.col("next_attempt_utc").alias("_next"))
    both = lookup_join(queue, f, ["batch_id"], "left")
    out = changed(both, F.col("_hit"), status=F.lit("pending"), retry_count=F.coalesce("retry_count", F.lit(0)) + 1, next_attempt_utc=F.col("_next"), last_error=F.col("_error"))
    return out.select(*queue.columns)


def failed_for_good(queue: DataFrame, failures: DataFrame) -> DataFrame:
    """Batches that won't be tried again. ``failures``: batch_id (unique) and error."""
    f = failures.select("batch_id", F.lit(True).alias("_hit"), S.capped(F.col("error"), 2000).alias("_error"))
    return changed(lookup_join(queue, f, ["batch_id"], "left"), F.col("_hit"), status=F.lit("failed"), last_error=F.col("_error")).select(*queue.columns)


def requeued(queue: DataFrame) -> DataFrame:
    """All failed batches wait again, at once and without their error."""
    none = F.lit(None).cast("string")
    return changed(queue, F.col("status") == "failed", status=F.lit("pending"), next_attempt_utc=none, last_error=none)


def recovered(queue: DataFrame) -> DataFrame:
    """Batches whose upload was cut off wait again."""
    return changed(queue, F.col("status") == "uploading", status=F.lit("pending"))


def marked(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Sets ``flag`` in the rows whose key is among ``ids``: errors reported, beats delivered."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return changed(lookup_join(df, hit, [key], "left"), F.col("_hit"), **{flag: F.lit(True)}).select(*df.columns)


def abandoned(runs: DataFrame) -> DataFrame:
    """Runs that a process left behind."""
    return changed(runs, F.col("status") == "running", status=F.lit("abandoned"), error_message=F.coalesce("error_message", F.lit("process terminated mid-run")))


def finished(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Closes runs. ``results``: sync_id (unique), finished_utc, status, rows_total and error_message."""
    names = ["finished_utc", "status", "rows_total", "error_message"]
    r = results.select("sync_id", F.lit(True).alias("_hit"), *(F.col(n).alias(f"_{n}") for n in names))
    return changed(lookup_join(runs, r, ["sync_id"], "left"), F.col("_hit"), **{n: F.col(f"_{n}") for n in names}).select(*runs.columns)


def appended(df: DataFrame, path: str, capped: dict[str, int] | None = None) -> None:
    """Adds rows to a table of errors, beats, runs or coverage; texts are cut to ``capped`` lengths."""
    df.withColumns({c: S.capped(F.col(c), n) for c, n in (capped or {}).items()}).write.mode("append").parquet(path)


def toggled(df: DataFrame, columns: list[str], due: Column) -> DataFrame:
    """The columns that are only asked for when ``due``; null otherwise, so that the schema stays."""
    return df.withColumns({c: F.when(due, F.col(c)) for c in columns})


def resolved_company(configured: Column, discovered: Column) -> Column:
    """The configured company, else the first discovered; null where there is neither."""
    return F.coalesce(F.nullif(F.trim(configured), F.lit("")), F.try_element_at(F.filter(discovered, lambda c: F.trim(c) != ""), F.lit(1)))


def same_local_day(a: Column, b: Column, zone: str) -> Column:
    """Do two instants (UTC) fall on one day of the zone?"""
    return F.to_date(F.from_utc_timestamp(a, zone)) == F.to_date(F.from_utc_timestamp(b, zone))
