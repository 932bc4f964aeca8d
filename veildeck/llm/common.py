"""What the operators share: the scratch folder, written tables, word rules."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java pattern; words are what lies between.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of a joined table up to which Spark may broadcast it.
FEW_ROWS = 1 << 16

#: Bytes of rows that a Python worker is sent at once, about, and the setting for it.
BATCH_BYTES, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: Folders of dealt() that a task may write at the same time; a setting, too.
OPEN_FOLDERS, OPEN_SETTING = 16, "spark.sql.maxConcurrentOutputFileWriters"

#: Paths given out by scratch(), in order.
MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared checkpoint folder. Where none is configured a local master gets a temporary
    one; a cluster, whose executors would not see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veildeck-")
        spark.conf.set("spark.checkpoint.dir", base)
    MADE.append(path := f"{base.rstrip('/')}/veildeck-{tag}-{uuid.uuid4().hex}")
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table written to the scratch folder: later stages restart from it, not from its lineage.

    The shuffle files behind it can then be freed, so the driver is asked to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, tag: str, column: str) -> tuple[DataFrame, str]:
    """df written with a folder for each value of a column, and the path; drop_part deletes one of them.

    Up to OPEN_FOLDERS folders are written side by side; else Spark would first sort all rows of a task by the column.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    before = spark.conf.get(OPEN_SETTING)
    spark.conf.set(OPEN_SETTING, max(int(before), OPEN_FOLDERS))
    try:
        df.write.partitionBy(column).parquet(path)
    finally:
        spark.conf.set(OPEN_SETTING, before)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def ready(spark: SparkSession) -> None:
    """Makes room for Python workers before a stage. They get their rows in batches of about BATCH_BYTES (Spark's own
    64 MB are held by the worker and, up to twice, beside the heap), unless the session has a setting of its own;
    and the executors give back what their heaps don't use, which they otherwise keep from earlier stages."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext._jvm.System.gc()
    else:
        give_back(spark, spark.sparkContext.defaultParallelism)


def give_back(spark: SparkSession, tasks: int) -> None:
    """That many tasks that collect their JVM's garbage; as many as there are cores meet all executors that are idle."""
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def release() -> None:
    """Gives the freed memory that this Python process still keeps back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run for mapInArrow, after which its worker, which Spark keeps for later tasks, holds no freed memory."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def drop_part(spark: SparkSession, path: str, column: str, value: int) -> None:
    delete(spark, f"{path}/{column}={value}")


def sweep(spark: SparkSession, since: int, keep: str) -> None:
    """Deletes what scratch() gave out from the since-th path on, but for the one that is kept."""
    for path in MADE[since:]:
        if path != keep:
            delete(spark, path)
    MADE[since:] = [keep]


def drop(*tables: DataFrame) -> None:
    """Deletes written() tables that no later stage reads."""
    for df in tables:
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/veildeck-" in name:
                delete(df.sparkSession, name)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df as one side of a join whose smaller side has that many rows at most. Spark goes by the bytes of Parquet
    files, where ids compress and rows still to be exploded are one; what it takes for 10 MB may fill the
    driver's heap. So only few rows are left to its choice, more are merged."""
    return df if rows <= FEW_ROWS else df.hint("merge")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
