"""Session helpers: tables, durable intermediate results, Arrow batch bounds."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only by a local master, where neither the session nor the context names a checkpoint folder (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Rows of one Arrow batch to a Python worker; texts are long, so far fewer than Spark's 10,000.
ARROW_ROWS = 512
#: Bytes of one piece of a batch, about.
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, whatever file system the folder is on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, else the context's checkpoint
    folder.  Where neither is set a local master gets LOCAL_CHECKPOINTS; on a cluster that would scatter files
    over the executors' disks, so it raises."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base
    if sc.master == "local" or sc.master.startswith("local["):
        return LOCAL_CHECKPOINTS
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def _until_exit(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared base, deleted when the driver ends in good order."""
    folder = f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _until_exit(spark, folder)
    return folder


def storage(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file and the path there, for workers: local paths and whatever Arrow opens."""
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), re.sub(r"\Afile:(//)?(?=/)", "", uri)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def numbered(df: DataFrame, by: str, name: str = "number") -> DataFrame:
    """``df`` with a number from 0 in the order of column ``by``.  Rows are dealt out by ranges of it; a range
    starts at the sum of the counts before it, so no task sorts all rows.  Rows of one value are numbered in any
    order; a value that many rows share makes one large range."""
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = durable(df.repartitionByRange(ranges, by).withColumn("_range", F.spark_partition_id()))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + inside).drop("_range", "_start")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read from there, so that lineage
    ends here and a lost executor costs nothing that is already computed.  A checkpoint folder set here is
    deleted when the driver ends; to drop checkpoints earlier, as soon as nothing refers to them, start the
    session with spark.cleaner.referenceTracking.cleanCheckpoints."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_base(df.sparkSession))
        _until_exit(df.sparkSession, sc.getCheckpointDir())
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and about ``size`` bytes, a row at least, so that what a
    worker makes of one piece is bounded too.  Spark itself bounds the batches it sends by bytes; no session
    setting is touched.  After the last piece the worker, which Spark keeps for later tasks, gives freed memory back."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > size:
                n = -(-n // 2)
            yield b.slice(at, n)
            at += n
    b = None
    give_back()


def give_back() -> None:
    """Memory that this process has freed goes back to the system, from Arrow's pool and, where there is one, from
    the C library's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def broadcast_if_few(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, written out, with a broadcast hint if it has at most ``rows`` rows; beyond, Spark joins by a
    shuffle.  For narrow tables."""
    df = durable(df)
    return F.broadcast(df) if df.count() <= rows else df
