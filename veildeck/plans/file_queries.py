"""Registered queries over files: made from the driver's tables, read again, and held against SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import elements, governance
from ..sources import dicom, files, volumes
from . import catalog as C
from . import planted as X
from .registry import _RESULT, _deidentified, query


def folder(spark: SparkSession, tag: str) -> str:
    """A new path that the driver and all executors share; a temporary one where a local master has none."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veildeck-")
    return f"{base.rstrip('/')}/veildeck-{tag}-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """file_id, content: each customer's record as a file."""
    top = X.elements(spark, sf).groupBy("file_id").agg(F.collect_list(F.struct("ord", F.get("path", F.lit(0))["tag"].alias("parent"), "tag", "vr", "value")).alias("rows"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = []
            for rows in b.column(1).to_pylist():
                inner: dict[int, list] = {}
                for r in rows:
                    if r["parent"] is not None:
                        inner.setdefault(r["parent"], []).append((r["tag"], r["vr"], r["value"]))
                nodes = [(r["tag"], r["vr"], [inner[r["tag"]]] if r["vr"] == "SQ" else r["value"]) for r in rows if r["parent"] is None]
                made.append(dicom.encoded(nodes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["file_id", "content"])

    return top.mapInArrow(run, "file_id string, content binary")


@query(f"WITH {X.elements_sql()} SELECT file_id, tag, vr, value, parent FROM e")
def record_files(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as files and read again, nested elements among them."""
    got = dicom.elements(_records(spark, sf)).where("skipped is null")
    return got.select("file_id", "tag", "vr", "value", F.coalesce(F.get("path", F.lit(0))["tag"], F.lit(0)).alias("parent"))


@query(f"WITH {_RESULT} SELECT file_id, tag, coalesce(result, '') AS value, parent FROM d WHERE code NOT IN ('X', 'GONE') AND vr <> 'SQ' AND (parent = 0 OR parent = {0x00101002}) UNION ALL SELECT DISTINCT file_id, {0x00120062}::BIGINT, 'YES', 0 FROM d")
def rewritten_files(spark: SparkSession, sf: str) -> DataFrame:
    """Whole files with every changed and removed element put in, read again: what is left is what the rules leave."""
    raw, done = _records(spark, sf), _deidentified(spark, sf)
    changes = done.where("changed or removed").select("file_id", "path", "tag", "result", "removed")
    marks = raw.select("file_id", F.array().cast("array<struct<tag:bigint,item:int>>").alias("path"), F.lit(0x00120062).cast("long").alias("tag"), F.lit("YES").alias("result"), F.lit(False).alias("removed"))
    again = dicom.elements(dicom.rewritten_files(raw, changes.unionByName(marks)).select("file_id", "content")).where("skipped is null and vr <> 'SQ'")
    return again.select("file_id", "tag", F.coalesce("value", F.lit("")).alias("value"), F.coalesce(F.get("path", F.lit(0))["tag"], F.lit(0)).alias("parent"))


def _volumes(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "nation").selectExpr("concat('v', n_nationkey, '.nii', if(n_nationkey % 2 = 0, '.gz', '')) as file_id", "n_nationkey as k", "n_name as name")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            made = []
            for k, name in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                a = np.arange(24, dtype="<i2").reshape(2, 3, 4) + k
                made.append(volumes.made(a, f"of {name}", 1 + k % 3 % 2, k % 2 == 0) if k % 7 else b"broken")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["file_id", "content"])

    return rows.mapInArrow(run, "file_id string, content binary")


@query("SELECT 'v' || n_nationkey || '.nii' || CASE WHEN n_nationkey % 2 = 0 THEN '.gz' ELSE '' END AS file_id, CASE WHEN n_nationkey % 7 <> 0 THEN 1 + n_nationkey % 3 % 2 END::INT AS version, CASE WHEN n_nationkey % 7 <> 0 THEN 'of ' || n_name END AS descrip, n_nationkey % 7 = 0 AS failed FROM nation")
def volume_headers(spark: SparkSession, sf: str) -> DataFrame:
    return volumes.headers(_volumes(spark, sf)).select("file_id", "version", "descrip", F.col("error").isNotNull().alias("failed"))


@query("SELECT 'v' || n_nationkey || '.nii' || CASE WHEN n_nationkey % 2 = 0 THEN '.gz' ELSE '' END AS file_id, '' AS descrip, 0 AS n_extensions FROM nation WHERE n_nationkey % 7 <> 0")
def volumes_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    clean = volumes.cleaned(_volumes(spark, sf)).where("error is null")
    return volumes.headers(clean.select("file_id", "content")).select("file_id", "descrip", "n_extensions")


@query("SELECT 'part-' || p_partkey % 10 || '/f' || p_partkey || '.txt' AS path, sha256(p_name) AS sha256, strlen(p_name)::BIGINT AS bytes FROM part WHERE p_partkey % 20 = 0")
def folder_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Files written below a folder, listed with their checksums; half of them as if they were too large for memory."""
    root = folder(spark, "files")
    rows = X.table(spark, sf, "part").where("p_partkey % 20 = 0").selectExpr("concat('part-', p_partkey % 10, '/f', p_partkey, '.txt') as file_id", "cast(p_name as binary) as content")
    from .corpus import written

    written(rows, root.removeprefix("file://")).count()
    half = rows.agg(F.coalesce(F.percentile_approx(F.length("content"), 0.5), F.lit(0))).first()[0]
    return governance.bundle_manifest(spark, root, in_memory=half).select("path", "sha256", "bytes")


@query("SELECT 'f' || o_orderkey AS rel_in, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'done' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS error FROM orders WHERE o_orderkey % 11 <> 0")
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A log of JSON lines: fields that a line lacks are null, lines that aren't JSON are left out."""
    path = folder(spark, "log")
    line = "case when o_orderkey % 11 = 0 then 'not json' when o_orderkey % 3 = 0 then concat('{\"rel_in\": \"f', o_orderkey, '\", \"error\": \"x\"}') else concat('{\"rel_in\": \"f', o_orderkey, '\", \"status\": \"done\"}') end as line"
    files.write_text(X.table(spark, sf, "orders").selectExpr(line), "line", path)
    return files.processing_log(spark, path).select("rel_in", "status", "error")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 4 <> 0")
def name_column(spark: SparkSession, sf: str) -> DataFrame:
    """One column of a table of names with a header of equal names, comments and repeats."""
    path = folder(spark, "names")
    n = X.table(spark, sf, "nation")
    lines = n.selectExpr("concat(n_nationkey, ';', if(n_nationkey % 4 = 0, '# ', '  '), n_name, ' ') as line").unionByName(n.selectExpr("concat('9;', if(n_nationkey % 4 = 0, '# ', ''), n_name) as line"))
    files.write_text(lines.coalesce(1).select("line"), "line", path)
    return files.name_table(spark, path, header=False, column=1)


@query("SELECT 'c' || c_custkey AS file_id, count(*)::BIGINT AS n_keys FROM (SELECT c_custkey, unnest(range(5)) FROM customer WHERE c_custkey % 50 <> 0) GROUP BY c_custkey")
def sidecar_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecars as files in folders, read through Spark's text reader; broken ones have no entries."""
    from ..operators import sidecars
    from .corpus import written

    root = folder(spark, "sidecars")
    written(X.sidecars(spark, sf).select("file_id", F.col("json").cast("binary").alias("content")), root.removeprefix("file://")).count()
    rows = sidecars.entries(files.sidecars(spark, root)).where("key is not null")
    return rows.groupBy(F.regexp_extract("file_id", r"([^/]*)\.json$", 1).alias("file_id")).agg(F.count("*").alias("n_keys"))


@query("SELECT 'f' || s_suppkey || '.bin' AS file_id, CASE s_suppkey % 4 WHEN 0 THEN 'missing_signature' WHEN 1 THEN 'hash_mismatch' WHEN 2 THEN 'malformed_signature' ELSE 'ok' END AS state, s_suppkey % 4 = 3 AS valid FROM supplier WHERE s_suppkey <= 8")
def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """A few files signed and then left, changed, or their signatures broken or deleted."""
    import os

    root = folder(spark, "signed").removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    states = []
    for r in X.table(spark, sf, "supplier").where("s_suppkey <= 8").select("s_suppkey", "s_name").collect():  # eight files
        path = f"{root}/f{r.s_suppkey}.bin"
        with open(path, "w") as f:
            f.write(r.s_name)
        sig = governance.signed(spark, path, f"{root}/keys")
        if r.s_suppkey % 4 == 0:
            os.remove(sig)
        elif r.s_suppkey % 4 == 1:
            with open(path, "a") as f:
                f.write("more")
        elif r.s_suppkey % 4 == 2:
            with open(sig, "w") as f:
                f.write("{")
        states.append((path, governance.signature_state(spark, path, f"{root}/keys/pipeline_ed25519.pub")))
    table = governance.signature_table(spark.createDataFrame([(p,) for p, _ in states], "path string"), spark.createDataFrame([s for s in states if s[1] != "missing_signature"], "path string, state string"))
    return table.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_id"), "state", "valid")


@query(f"WITH {_RESULT}, w AS (SELECT DISTINCT result AS pseudonym, value AS original FROM d WHERE code IN ('H', 'D', 'U') AND k <= 20) SELECT pseudonym, original FROM w")
def keystore_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A small crosswalk sealed under a passphrase and opened again."""
    import os

    from ..operators.keystore import Keystore

    done = _deidentified(spark, sf).where("cast(substr(file_id, 2) as int) <= 20")
    store = Keystore(salt=b"s" * 32, reversible=True)
    for r in elements.crosswalk(elements.records(done)).collect():  # twenty records
        store.record(r.pseudonym, r.category, r.original)
    path = folder(spark, "keys").removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    store.save(spark, f"{path}/keystore.json", "open sesame")
    return Keystore.open(spark, f"{path}/keystore.json", "open sesame").crosswalk(spark).select("pseudonym", "original")


@query("SELECT upper(replace(x.k, '_', '')) AS category, count(*)::BIGINT AS n FROM (SELECT unnest([" + ", ".join(f"'{c[0]}'" for c in C.CATEGORIES for _ in c[3]) + "]) AS k) AS x GROUP BY 1")
def catalog_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of each category of the default catalog."""
    rows = spark.createDataFrame([(c[0], t) for c in C.CATEGORIES for t in c[3]], "category string, tag string")
    return rows.groupBy(F.upper(F.replace("category", F.lit("_"), F.lit(""))).alias("category")).agg(F.count("*").alias("n"))
