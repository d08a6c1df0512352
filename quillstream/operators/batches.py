"""Content-addressed batches: slices, checksums, identities and what is sent already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.operators.numbering import numbered
from quillstream.session import lookup_join

#: Columns that say when and by which run a row was delivered; they are no content.
AUDIT = ["_sync_timestamp", "_sync_id", "source_last_seen_at"]


def sliced(df: DataFrame, by: list[str], bucket: str, order: list[str], rows: int) -> DataFrame:
    """Adds row_nr and slice_no: every ``rows`` rows of ``by`` in ``order`` make a slice.

    ``bucket`` must rise with ``order`` and keep its rows within one task's reach.
    """
    return numbered(df, by, bucket, [F.col(o) for o in order]).withColumn("slice_no", F.floor(F.col("row_nr") / rows))


def content_line(df: DataFrame) -> Column:
    """A row's content as one text: its columns but for the audit ones by name, nulls marked."""
    cols = sorted(c for c in df.columns if c not in AUDIT)
    return F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in cols))


def checksums(slices: DataFrame, by: list[str], line: Column, number: str = "row_nr") -> DataFrame:
    """The SHA-256 of each slice's lines in order; a slice has a bounded number of rows."""
    rows = slices.select(*by, "slice_no", F.struct(F.col(number).alias("n"), line.alias("line")).alias("r"))
    return rows.groupBy(*by, "slice_no").agg(F.count("*").alias("record_count"), F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"])), 256).alias("content_checksum"))


def next_sequence(queue: DataFrame, history: DataFrame) -> DataFrame:
    """The next number of each dataset: one above the highest in use or used up."""
    both = queue.select("dataset", "sequence_no").unionByName(history.select("dataset", "sequence_no"))
    return both.groupBy("dataset").agg((F.coalesce(F.max("sequence_no"), F.lit(0)) + 1).alias("next_sequence"))


def equivalents(new: DataFrame, queue: DataFrame, active: list[str]) -> DataFrame:
    """For each new batch the oldest active one of the same content, null where there is none.

    The same: dataset, company, content checksum, record count and window, whose
    bounds may both be null.
    """
    keys = ["dataset", "company", "content_checksum", "record_count", "window_from", "window_to"]
    w = Window.partitionBy(*keys).orderBy("created_utc", "sequence_no", "batch_id")
    oldest = queue.filter(F.col("status").isin(*active)).withColumn("nr", F.row_number().over(w)).filter("nr = 1").select(*(F.col(k).alias(f"q_{k}") for k in keys), F.col("batch_id").alias("same_as"))
    on = F.lit(True)
    for k in keys:
        on = on & new[k].eqNullSafe(oldest[f"q_{k}"])
    return new.join(oldest, on, "left").select(*new.columns, "same_as")


def suppressed(new: DataFrame, queue: DataFrame, active: list[str]) -> DataFrame:
    """The new batches that no active one equals."""
    return equivalents(new, queue, active).filter("same_as is null").drop("same_as")


def orphan_payloads(files: DataFrame, queue: DataFrame, now: str, grace_seconds: int = 3600) -> DataFrame:
    """Files no batch refers to: unfinished ones at once, others after the grace."""
    aged = F.col("modified") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(grace_seconds))
    loose = files.join(queue.select(F.col("payload_path").alias("path")).distinct(), "path", "left_anti")
    return loose.filter(F.col("path").endswith(".tmp") | aged)


def missing_payloads(queue: DataFrame, files: DataFrame, waiting: list[str]) -> DataFrame:
    """Waiting batches whose file is gone."""
    return queue.filter(F.col("status").isin(*waiting)).join(files.select(F.col("path").alias("payload_path")), "payload_path", "left_anti")


def acknowledged(queue: DataFrame, history: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves the acknowledged batches from the queue to the history: both anew.

    An acknowledged batch that the history has already takes its place there.
    """
    acks = acks.select("batch_id").distinct()
    moved = lookup_join(queue, acks, ["batch_id"], "left_semi")
    left = lookup_join(queue, acks, ["batch_id"], "left_anti")
    kept = lookup_join(history, acks, ["batch_id"], "left_anti")
    return left, kept.unionByName(moved.select(history.columns))
