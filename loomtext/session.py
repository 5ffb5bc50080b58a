"""What operators need of a session: bounded Arrow batches, the shared folder, written cuts. Imports nothing of the library."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch. All operators use these, so it doesn't matter whose plan is built last.
BATCH_ROWS, BATCH_BYTES = 20_000, 2 << 20
#: Rows that share a file of a small cut.
FILE_ROWS = 10_000
#: Used only by a single machine that names no shared folder (tests).
FALLBACK_DIR = "/tmp/checkpoints"


def arrow_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once by bytes; a user's tighter bound stays. Spark reads this when a plan runs."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        own = str(spark.conf.get(f"spark.sql.execution.arrow.{key}")).lower().removesuffix("b")
        own = int(own) if own.isdigit() else 0
        if not 0 < own <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    # The shuffle files of a finished write are of no further use: cuts are read from their own files.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to as many tasks as a shuffle has, by keys if given: for short rows that take long each.

    Files and shuffles are cut into tasks by their bytes, so a small table of such rows would run in one or two.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism), *keys)


def give_back() -> None:
    """Return freed memory to the system, as a worker that is reused would keep it for the tasks that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, giving back freed memory when its task ends."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def shared_dir(spark: SparkSession, name: str = "loomtext") -> str:
    """A new folder name below the folder that the driver and all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = FALLBACK_DIR
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """Write df to path and read it back: the lineage ends there, and a lost executor costs no recomputation.

    rows: at least as many as the last stage of df reads. Few of them share tasks, and so files: on a local disk Hadoop
    runs chmod for files it creates, and such a process shares all of the executor's JVM until its program is loaded.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written cut that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
