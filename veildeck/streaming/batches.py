"""Resumable batches as a file stream: the offset log gives each file to one micro-batch once.

What a claim, a stale reset and a worker's loop do by hand, the checkpoint does: a batch that wasn't
committed is read again, and files already in the results are passed over by key, so a replay adds nothing.
Files of no bytes are not read by Spark's file sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def drained(spark: SparkSession, root_in: str, results: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], batch_id: str, files_per_trigger: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Runs work on every new file below root_in and appends its rows to the Parquet table results.

    work takes path, rel_in, content and returns rows with rel_in, status and error at least."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(root_in)
    root = root_in.rstrip("/") + "/"

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("rel_in", F.regexp_replace("path", r"^.*?" + root.replace(".", r"\."), ""))
        try:
            done = spark.read.parquet(results).where(F.col("batch_id") == batch_id).select("rel_in")
            rows = rows.join(done, "rel_in", "left_anti")
        except Exception as e:  # noqa: BLE001 - before the first batch there is no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        work(rows).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(results)

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watched_progress(spark: SparkSession, results: str) -> DataFrame:
    """Files by status, for a table that a stream appends to."""
    return spark.read.parquet(results).groupBy("batch_id", "status").agg(F.count("*").alias("n"))
