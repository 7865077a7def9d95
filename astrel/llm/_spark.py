"""Spark helpers: scratch tables in the shared folder, exchange sizes, checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small table may be broadcast; callers count the rows first.
BROADCAST_ROWS = 1_000_000
#: Bytes of files (or Catalyst's estimate) up to which it may be.
BROADCAST_BYTES = 24 << 20
#: Bytes of input that one partition of a packed exchange serves.
EXCHANGE_BYTES = 16 << 20
#: Partitions of a packed exchange for which a table of short rows has one file.
FEW = 12
#: For tables in a folder of the file: scheme.  Where Hadoop has no native library, its usual local file system starts chmod for each file, for the file of
#: its checksums and for its task's folder; a process that an executor starts has the executor's memory at first, and counts as another executor until it
#: is chmod.  This one writes no checksums besides Parquet's own.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where that is unset and all runs on this machine, as in tests, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="astrel-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_made: ContextVar[list | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession) -> str:
    """A new path in this application's part of the shared folder."""
    path = f"{shared_dir(spark)}/astrel/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def step(spark: SparkSession, made: list):
    """A step whose last written table is its result: what it wrote before, and what stands in made, is deleted at its end; made then holds the result's path."""
    token = _made.set([])
    try:
        yield
        new = _made.get()
        for path in [*made, *new[:-1]]:
            delete(spark, path)
        made[:] = new[-1:]
    finally:
        _made.reset(token)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, *parts: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, prunes columns.

    The tables lie under <shared>/astrel/<application id>; the caller's platform
    removes that folder with the application, or release() does.  In a folder of the
    file: scheme they have no .crc files.
    """
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write.options(**PLAIN_FILES)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results not yet written elsewhere become unreadable."""
    delete(spark, f"{shared_dir(spark)}/astrel/{spark.sparkContext.applicationId}")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df: the pruned file sizes for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(df: DataFrame) -> int:
    """Partitions of a packed exchange of what df holds; grows with the input."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    size = input_bytes(df)
    return n if size >= 1 << 60 else min(max(n, size // EXCHANGE_BYTES + 1), 200_000)


def few(df: DataFrame, of: int) -> DataFrame:
    """df, a table of short rows made beside a packed exchange of so many partitions, in a file for FEW of these at most: its files grow with the input too."""
    return df.coalesce(-(-of // FEW))


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (BROADCAST_ROWS) and BROADCAST_BYTES, else df: AQE then joins by shuffle."""
    rows = BROADCAST_ROWS if rows is None else min(rows, BROADCAST_ROWS)
    return F.broadcast(df) if input_bytes(df) <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows else df


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def over(batches):
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(over, schema)


def text_ids(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, null for neither missing: the columns that most operators read."""
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
