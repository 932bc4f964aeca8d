"""The batch manifest as tables: registration, claims, results, resets, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import first_of

EXTENSIONS = r"(?i)\.(dcm|dicom|ima|nii|nii\.gz)$"
STATUSES = ("pending", "in_progress", "done", "failed", "flagged")
FILES = "id long, batch_id string, rel_in string, rel_out string, input_path string, output_path string, status string, worker string, started_at string, finished_at string, residual_count long, modality string, transfer_syntax string, input_sha256 string, output_sha256 string, error string"
BATCHES = "batch_id string, profile_id string, created_at string, created_by string, total long"


def relative(path: Column, root: str) -> Column:
    """The path below root, or the bare name elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


def scanned_files(paths: DataFrame) -> DataFrame:
    return paths.where(F.col("path").rlike(EXTENSIONS))


def registered(files: DataFrame, paths: DataFrame, batch_id: str, root_in: str, root_out: str) -> DataFrame:
    """files with a pending row for each path of the batch that isn't there yet. Ids follow the largest one
    in order of the relative path."""
    new = paths.select(F.col("path").alias("input_path"), relative(F.col("path"), root_in).alias("rel_in")).dropDuplicates(["rel_in"])
    have = files.where(F.col("batch_id") == batch_id).select("rel_in")
    new = new.join(have, "rel_in", "left_anti")
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = _numbered(new, "rel_in").crossJoin(F.broadcast(top))
    rows = numbered.select((F.col("n") + F.col("top")).alias("id"), F.lit(batch_id).alias("batch_id"), "rel_in", F.col("rel_in").alias("rel_out"), "input_path", F.concat(F.lit(root_out.rstrip("/") + "/"), F.col("rel_in")).alias("output_path"), F.lit("pending").alias("status"))
    return files.unionByName(rows, allowMissingColumns=True)


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """df with n from 1 in order of the key: ranges are sorted and numbered apart, then moved by what the
    ranges before them hold, so no task sees all rows."""
    from pyspark.sql import Window as W

    parts = df.repartitionByRange(key).withColumn("__p", F.spark_partition_id())
    inner = parts.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy(key)))
    sizes = inner.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("a.__p") > F.col("b.__p"), "left").groupBy("a.__p").agg(F.coalesce(F.sum("b.__c"), F.lit(0)).alias("__before"))
    return inner.join(F.broadcast(before), "__p").withColumn("n", F.col("__k") + F.col("__before")).drop("__p", "__k", "__before")


def batch_totals(batches: DataFrame, files: DataFrame, batch_id: str, profile_id: str, now: str, by: str | None = None) -> DataFrame:
    """batches with the batch added, or its total and profile renewed; when and by whom it was made stays."""
    new = files.where(F.col("batch_id") == batch_id).agg(F.count("*").alias("total")).select(F.lit(batch_id).alias("batch_id"), F.lit(profile_id).alias("profile_id"), F.lit(now).alias("created_at"), F.lit(by).cast("string").alias("created_by"), "total")
    o, n = batches.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.batch_id") == F.col("n.batch_id"), "full_outer")
    pick = lambda c, first, second: F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c)
    kept = lambda c: F.when(F.col("o.batch_id").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(pick("batch_id", "o", "n"), pick("profile_id", "n", "o"), kept("created_at"), kept("created_by"), pick("total", "n", "o"))


def claimed(files: DataFrame, worker: str, now: str, n: int = 1, batch_id: str | None = None) -> DataFrame:
    """files with the first n pending rows in progress. Spark tasks don't compete for rows: one call claims
    for one run, and the streaming form leaves it to the offset log."""
    pending = files.where((F.col("status") == "pending") & (F.lit(True) if batch_id is None else F.col("batch_id") == batch_id))
    first = pending.orderBy("id").limit(n).select("id", F.lit(True).alias("__c"))
    rows = files.join(first, "id", "left")
    return rows.withColumn("status", F.when(F.col("__c"), "in_progress").otherwise(F.col("status"))).withColumn("worker", F.when(F.col("__c"), worker).otherwise(F.col("worker"))).withColumn("started_at", F.when(F.col("__c"), now).otherwise(F.col("started_at"))).drop("__c").select(*files.columns)


def rebound(files: DataFrame, root_in: str | None = None, root_out: str | None = None) -> DataFrame:
    """Paths under new roots, where a relative path is known."""
    out = files
    for root, rel, path in ((root_in, "rel_in", "input_path"), (root_out, "rel_out", "output_path")):
        if root is not None:
            out = out.withColumn(path, F.when(F.coalesce(F.col(rel), F.lit("")) != "", F.concat(F.lit(root.rstrip("/") + "/"), F.col(rel))).otherwise(F.col(path)))
    return out


def finished(files: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """files with results (id, residual_count, error, and any of the file's other columns) put in: failed
    with an error, flagged with findings, done otherwise; what a result leaves null stays."""
    extra = [c for c in ("output_path", "modality", "transfer_syntax", "input_sha256", "output_sha256") if c in results.columns]
    new = results.select("id", F.col("residual_count").alias("__rc"), F.col("error").alias("__err"), *[F.col(c).alias(f"__{c}") for c in extra], F.lit(True).alias("__hit"))
    rows = files.join(new, "id", "left")
    status = F.when(F.col("__err").isNotNull(), "failed").when(F.col("__rc") > 0, "flagged").otherwise("done")
    out = rows.withColumn("status", F.when(F.col("__hit"), status).otherwise(F.col("status"))).withColumn("finished_at", F.when(F.col("__hit"), now).otherwise(F.col("finished_at")))
    out = out.withColumn("residual_count", F.when(F.col("__hit") & F.col("__err").isNull(), F.col("__rc")).otherwise(F.col("residual_count"))).withColumn("error", F.when(F.col("__hit"), F.coalesce("__err", "error")).otherwise(F.col("error")))
    for c in extra:
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.select(*files.columns)


def reset_stale(files: DataFrame, batch_id: str | None = None) -> DataFrame:
    stale = (F.col("status") == "in_progress") & (F.lit(True) if batch_id is None else F.col("batch_id") == batch_id)
    out = files.withColumn("__s", stale)
    for c in ("worker", "started_at"):
        if c in files.columns:
            out = out.withColumn(c, F.when(~F.col("__s"), F.col(c)))
    return out.withColumn("status", F.when(F.col("__s"), "pending").otherwise(F.col("status"))).select(*files.columns)


def with_residual(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Findings of a later scan by output path (output_path, n): done and flagged follow them."""
    rows = files.join(counts.select("output_path", F.col("n").alias("__n")), "output_path", "left")
    status = F.when(F.col("__n").isNull() | ~F.col("status").isin("done", "flagged"), F.col("status")).when(F.col("__n") > 0, "flagged").otherwise("done")
    return rows.withColumn("status", status).withColumn("residual_count", F.coalesce("__n", "residual_count")).select(*files.columns)


def progress(files: DataFrame, batch_id: str | None = None) -> DataFrame:
    """One row: total and the number of files of each status."""
    rows = files if batch_id is None else files.where(F.col("batch_id") == batch_id)
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def recent(files: DataFrame, n: int = 15) -> DataFrame:
    return files.orderBy(F.desc(F.coalesce("finished_at", "started_at", F.lit(""))), F.desc("id")).limit(n)


def failures(files: DataFrame) -> DataFrame:
    return files.where("status = 'failed'").select("input_path", "error")


def remaining(files: DataFrame) -> DataFrame:
    return files.where("status = 'pending'")


def profile_of(batches: DataFrame, batch_id: str, default: str = "default") -> str:
    row = batches.where(F.col("batch_id") == batch_id).agg(F.max("profile_id").alias("p")).first()
    return row.p or default


def latest(log: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last state of each key of a log of states."""
    return first_of(log, [key], *order)
