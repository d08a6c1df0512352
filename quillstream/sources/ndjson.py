"""Batches as compressed JSON lines: written with all columns, read with a declared schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """One gzip file of JSON lines a task, in folders ``by`` where given; nulls are written out."""
    out = df.write.mode(mode).option("compression", "gzip").option("ignoreNullFields", "false")
    (out.partitionBy(*by) if by else out).json(path)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Blank lines are skipped; a line that doesn't parse gives nulls and stays."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def envelope(df: DataFrame, meta: dict[str, str], by: list[str]) -> DataFrame:
    """One JSON text a batch: its metadata and its records; a batch must be bounded by ``by``."""
    records = df.groupBy(*by).agg(F.count("*").alias("record_count"), F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))).alias("records"))
    return records.select(*by, F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in meta.items()), "record_count", "records")).alias("body"))


def sealed(df: DataFrame, by: str, root: str) -> DataFrame:
    """Writes a batch a value of ``by`` and gives the rows of the queue: ``by``, record_count, payload_path, checksum_sha256, payload_bytes.

    ``by`` must bound its batches, of one file each. All are written beside
    ``root`` first; only when they are whole, and their bytes hashed, does the
    folder get its name. A ``root`` that is there already is an error.
    """
    spark = df.sparkSession
    staging = f"{root}.{uuid.uuid4().hex}.tmp"
    write(df.repartition(by), staging, [by])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (staging, root))
    fs = new.getFileSystem(conf)
    if fs.exists(new) or not fs.rename(old, new):
        fs.delete(old, True)
        raise FileExistsError(root)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").option("recursiveFileLookup", "true").load(root)
    value = F.regexp_extract("path", rf"/{by}=([^/]*)/", 1).cast(df.schema[by].dataType)
    hashed = files.select(value.alias(by), F.col("path").alias("payload_path"), F.sha2("content", 256).alias("checksum_sha256"), F.col("length").alias("payload_bytes"))
    return df.groupBy(by).agg(F.count("*").alias("record_count")).join(hashed, by)
