"""Files that arrive, as streams: counted by day, merged by key, and thinned out.

Sinks are tables in the shared folder, written once a micro-batch, so a batch
that is run again after a failure leaves the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quillstream.operators.warehouse import latest
from quillstream.session import shared_dir, shipped


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the parquet table ``name`` of a folder, be it a file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None = None) -> None:
    """Runs a stream over all there is, then ends. Run again with its ``checkpoint``, it goes on where it ended."""
    folder = checkpoint or f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()


def daily_counts(events: DataFrame, at: str, by: list[str]) -> DataFrame:
    """Rows a day and group of a stream, as a table: the state of the last micro-batch.

    Complete mode, so that the last days come out too; the state is bounded by days and groups.
    """
    spark = events.sparkSession
    days = events.withColumn("_at", F.col(at).cast("timestamp")).groupBy(F.window("_at", "1 day").alias("w"), *by).agg(F.count("*").alias("n"))
    path = f"{shared_dir(spark).rstrip('/')}/daily-{uuid.uuid4().hex}"
    run(days.select(F.col("w.start").alias("day"), *by, "n"), lambda df, _: df.write.mode("overwrite").parquet(path), "complete")
    return spark.read.parquet(path)


#: Parts of a streamed state; a micro-batch rewrites those it has keys of.
STATE_PARTS = 64


def _numbers(spark: SparkSession, base: str) -> list[int]:
    """The micro-batches whose state is whole, in order: Spark marks what it wrote to the end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def upserted(events: DataFrame, keys: list[str], order: list[str], base: str | None = None) -> DataFrame:
    """The latest row of each key of a stream, as a table.

    The state lies in ``base``, which also holds the stream's checkpoint, in
    ``STATE_PARTS`` parts by key. A micro-batch writes only the parts it has keys
    of, under its own number; a part's state is what the newest batch wrote of it.
    Which batches are whole is read from the folder, so that a stream that is
    started again, or a batch that is run again, finds the same state.
    """
    spark = events.sparkSession
    base = base or f"{shared_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64(*keys), F.lit(STATE_PARTS)).cast("int")

    def state(before: int | None = None) -> DataFrame | None:
        numbers = [n for n in _numbers(spark, f"{base}/state") if before is None or n < before]
        if not numbers:
            return None
        rows = spark.read.schema(StructType([*events.schema.fields, StructField("part", IntegerType()), StructField("batch", LongType())])).option("basePath", f"{base}/state").parquet(*(f"{base}/state/batch={n}" for n in numbers))
        newest = rows.groupBy("part").agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(newest), ["part", "batch"], "left_semi").drop("batch")

    def merge(df: DataFrame, number: int) -> None:
        new, old = df.withColumn("part", part), state(number)
        if old is not None:
            touched = new.select("part").distinct()  # at most STATE_PARTS rows
            new = new.unionByName(old.join(F.broadcast(touched), "part", "left_semi"))
        latest(new.drop("part"), keys, order).withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{base}/state/batch={number}")

    run(events, merge, "append", f"{base}/checkpoint")
    done = state()
    return done.select(*events.columns) if done is not None else spark.createDataFrame([], events.schema)


def throttled(df: DataFrame, key: Column, at: str, unique: str, minutes: int) -> DataFrame:
    """The alerts that go out: of a key none within ``minutes`` of the last that did.

    Suppressed alerts don't reset the clock, so the rule looks back at what was
    sent. But an alert after a pause of that length always goes out: such pauses
    cut a key's alerts into stretches that are thinned apart from each other, in
    order of time, with one value of state.
    """
    shipped(df.sparkSession)
    seconds = F.col(at).cast("timestamp").cast("double")
    w = Window.partitionBy("_key").orderBy("_s", unique)
    rows = df.select(key.cast("string").alias("_key"), seconds.alias("_s"), F.col(unique))
    pause = F.coalesce(F.col("_s") - F.lag("_s").over(w) >= minutes * 60, F.lit(True))
    parts = rows.withColumn("_new", pause.cast("int")).withColumn("_part", F.sum("_new").over(w))

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, sent = None, 0.0
        for pdf in batches:
            keep = []
            for k, p, s in zip(pdf["_key"], pdf["_part"], pdf["_s"]):
                goes = (k, p) != part or s - sent >= minutes * 60
                part = (k, p)
                sent = s if goes else sent
                keep.append(goes)
            yield pdf[keep][["_key", unique]]

    sorted_rows = parts.repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_s", unique)
    kind = dict(df.dtypes)[unique]
    return sorted_rows.select("_key", "_part", "_s", unique).mapInPandas(thin, f"_key string, {unique} {kind}").withColumnRenamed("_key", "alert_key")
