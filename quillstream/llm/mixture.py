"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash, once for every copy allowed. A
document's virtual finish time is the number of its source's tokens up to and
with it, divided by the source's weight. Sorted by finish time, every prefix of
the queue holds the weights to within a document, so the mix is the queue up to
the token budget. Running sums have two levels: the hash (or the finish time)
is cut into buckets of bounded size, the sums of buckets are accumulated, and
only a bucket is summed up within one task, so that a source may hold any part
of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import plain_or_null
from quillstream.llm import tokenizer
from quillstream.operators.numbering import running_sum
from quillstream.session import lookup_join, stored

#: Rows that share a bucket of a running sum, about.
BUCKET_ROWS = 20_000


def sized(documents: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, path: str) -> DataFrame:
    """doc_id, source (plain) and n_tokens of the documents of a target source, stored."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), plain_or_null(source).alias("source"), F.col(text).alias("text")).filter("source is not null")
    wanted = lookup_join(docs, targets.select("source"), ["source"], "left_semi", salt_by="doc_id")
    return stored(tokenizer.token_counts(wanted, ["doc_id", "source"], "text", path), "sized")


def target_table(targets: DataFrame) -> DataFrame:
    """source (plain), target_share and max_repeats, the first of repeated sources by share; others left out: blank sources and shares not above 0."""
    t = targets.select(plain_or_null("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("long").alias("max_repeats"))
    best = t.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("v"))
    return best.select("source", "v.*")


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, copy_no (from 1), n_tokens, finish_at and mix_offset, in the order of the mix.

    ``sizes`` is the result of ``sized``, ``targets`` that of ``target_table``.
    Weights are the target shares of the sources that have tokens, scaled to sum
    to 1. Without ``total_tokens`` the budget is the largest at which every
    source can hold its share within max_repeats. With it, sources that run out
    fall short and the rest of the queue moves up. Documents without tokens are
    left out. ``mix_offset`` is the number of tokens before a row. An empty
    table or no usable target gives no rows.
    """
    filled = sizes.filter("n_tokens > 0")
    per_source = filled.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.max("n_tokens").alias("longest")).join(targets, "source")
    # one row of totals, whatever the number of sources
    total = per_source.agg(F.sum("target_share").alias("weight"), F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share")).alias("room"), F.max("docs").alias("docs"), F.sum(F.col("docs") * F.col("max_repeats")).alias("rows"), F.max(F.col("longest") / F.col("target_share")).alias("lag")).first()
    weight, budget = total["weight"] or 1.0, total_tokens if total_tokens is not None else int((total["room"] or 0) * (total["weight"] or 1.0))
    bits = (int(total["docs"] or 1) // BUCKET_ROWS).bit_length()
    slices = max(1, int(total["rows"] or 0) // BUCKET_ROWS)

    # a source lags behind its share by less than one document: at this time each has given its share of the budget
    until = budget + (total["lag"] or 0.0) * weight
    # no source needs more copies than last until then (all of them if others may run out)
    need = F.ceil(F.lit(float(until)) * F.col("target_share") / weight / F.col("tokens")) if total_tokens is None else F.col("max_repeats")
    sources = per_source.select("source", "tokens", (F.col("target_share") / weight).alias("share"), F.least("max_repeats", need).cast("long").alias("copies"))
    copies = lookup_join(filled, sources, ["source"], salt_by="doc_id").filter("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    # the top bits of the hash are the bucket, so buckets rise with it
    shuffled = copies.withColumn("turn", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "copy_no", "doc_id"), 1)).withColumn("bucket", F.shiftrightunsigned("turn", 63 - bits))
    order = [F.col("turn"), F.col("doc_id")]
    queued = running_sum(shuffled, ["source", "copy_no"], "bucket", order, "n_tokens", "source_tokens")
    done = F.col("source_tokens") + (F.col("copy_no") - 1) * F.col("tokens")
    times = queued.withColumn("finish_at", done / F.col("share"))
    if total_tokens is None:
        # what starts later is beyond the cut in any case
        times = times.filter((done - F.col("n_tokens")) / F.col("share") <= until)
        width = max(1.0, budget / slices)
    else:
        width = max(1.0, (total["room"] or 0) * weight / slices)
    times = times.select("doc_id", "source", "copy_no", "n_tokens", "finish_at", F.floor(F.col("finish_at") / width).alias("slice"))
    last = [F.col("finish_at"), F.col("source"), F.col("copy_no"), F.col("doc_id")]
    summed = running_sum(times, [], "slice", last, "n_tokens", "upto")
    kept = summed.filter(F.col("upto") <= budget).select("doc_id", "source", "copy_no", "n_tokens", "finish_at", (F.col("upto") - F.col("n_tokens")).alias("mix_offset"))
    return kept.repartitionByRange("mix_offset", "finish_at").sortWithinPartitions("mix_offset", "finish_at")


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source has and gives: available, mixed, most copies of one document, and its actual share."""
    there = sizes.groupBy("source").agg(F.count_if(F.col("n_tokens") > 0).alias("docs_available"), F.sum("n_tokens").alias("tokens_available"))
    used = mixed.groupBy("source").agg(F.count("*").alias("docs_mixed"), F.sum("n_tokens").alias("tokens_mixed"), F.max("copy_no").alias("copies_used"))
    everything = Window.partitionBy(F.lit(0))  # a row a source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counts = ["docs_available", "tokens_available", "docs_mixed", "tokens_mixed", "copies_used"]
    joined = targets.join(there, "source", "left").join(used, "source", "left").select("source", "target_share", "max_repeats", *map(zero, counts))
    total = F.sum("tokens_mixed").over(everything)
    return joined.withColumn("actual_share", F.when(total > 0, F.col("tokens_mixed") / total).otherwise(0.0))
