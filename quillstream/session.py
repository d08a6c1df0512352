"""Session helpers: table access, the shared folder, size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their values, of a lookup side up to which it may be broadcast; beyond either, the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: Rows of one key in a shuffled join from which they are parted.
KEY_ROWS = 2_000_000


def local_session(cores: str = "4", partitions: int = 8) -> SparkSession:
    """A session for tests, benchmarks and single-machine use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillstream")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, before a frame runs its Python there.

    The driver's file server hands the archive out, so executors need neither
    the package on their path nor a folder in common with the driver for it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillstream-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/quillstream.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with a partition for each core at least, for work that costs more than moving its rows.

    Only inputs of fewer splits than cores are moved; larger ones stay as they lie.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local is a temporary folder made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="quillstream-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(f"file://{made}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to and read from a compressed table in the shared folder.

    For results that several later stages read: smaller than a checkpoint and
    open to column pruning. The table is removed by ``release``, or when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _STORED:
        atexit.register(release)
    _STORED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Removes all stored tables. For long sessions, once the results that came from them are written.

    Checkpoints are removed by Spark as the frames that hold them are forgotten,
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    while _STORED:
        _remove(*_STORED.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the driver is ending
        pass


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row's values."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) if f.dataType.typeName() in ("array", "map", "struct") else F.lit(8) for f in df.schema]
    return sum(sizes, F.lit(0)).cast("long")


def may_broadcast(small: DataFrame, rows: int | None = None) -> bool:
    """Whether a frame's rows and their bytes, both counted, are few enough to broadcast."""
    n, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes(small)), F.lit(0))).first()
    return n <= (BROADCAST_ROWS if rows is None else rows) and size <= BROADCAST_BYTES


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salt_by: str | None = None, rows: int | None = None, fits: bool | None = None) -> DataFrame:
    """Joins ``big`` to ``small``, whose keys are unique, whatever the skew of ``big``.

    ``small`` is measured first: up to ``rows`` rows (``BROADCAST_ROWS``) and
    ``BROADCAST_BYTES`` bytes it is broadcast. Beyond, the rows of ``big`` are
    counted by key, and those of a key with more than ``KEY_ROWS`` are parted by
    a hash of ``salt_by``, into as many parts as that takes; only the row that
    such a key has in ``small`` is copied, once a part. Of such keys there are
    no more than ``big`` has rows divided by ``KEY_ROWS``. ``how`` is inner,
    left, left_semi or left_anti. Null keys match nothing. ``fits`` is what
    ``may_broadcast`` said of ``small``, where a caller knows it already.
    """
    if fits or fits is None and may_broadcast(small, rows):
        return big.join(F.broadcast(small), keys, how)
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > KEY_ROWS)
    hot = cut(counts.select(*keys, F.ceil(F.col("_n") / KEY_ROWS).cast("int").alias("_parts")))
    if hot.isEmpty():
        return big.join(small, keys, how)
    hot = F.broadcast(hot)
    parted = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    by = F.xxhash64(salt_by) if salt_by else F.xxhash64(*big.columns)
    salted = big.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(by, F.col("_parts")).cast("int"))).drop("_parts")
    return salted.join(parted, [*keys, "_salt"], how).drop("_salt")
