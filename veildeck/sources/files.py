"""Sources: file trees, name lists, JSON lines, sidecars."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learning import EXAMPLES
from ..operators.manifest import scanned_files

AUDIT = "seq long, ts string, actor string, role string, action string, details string, prev_hash string, hash string"
PROCESSING = "ts string, rel_in string, rel_out string, input_sha256 string, output_sha256 string, residual_count long, status string, signature_id string, error string"


def tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, rel, bytes, and content if asked, of every file below a folder, or of one file. Without content
    only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")
    plain = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    rel = F.when(plain.startswith(base + "/"), F.substring(plain, len(base) + 2, 1 << 30)).otherwise(F.regexp_extract(plain, r"([^/]*)$", 1))
    return files.select("path", rel.alias("rel"), F.col("length").alias("bytes"), *(["content"] if content else []))


def images(spark: SparkSession, root: str) -> DataFrame:
    return scanned_files(tree(spark, root))


#: Files that one task opens, and bytes from which on it puts out a batch.
FILES_A_TASK, MOST_BYTES = 4096, 4 << 20
#: ASCII characters that a path keeps in a URI.
IN_URI = re.compile(r"[^\x80-\U0010ffff/0-9A-Za-z!'()*,;:$&+=@_.~-]")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """file_id, json of the .json files below a folder.

    A folder of the local file system, which all executors see, is listed and read by Python tasks: Spark's text
    reader takes milliseconds for each small file, and a task for every 32. Other stores are read by it."""
    local = re.sub(r"^file:/+", "/", root)
    if local.startswith("/") and (local != root or spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").startswith("file:")) and os.path.isdir(local):
        return _local_sidecars(spark, local)
    return _read_sidecars(spark, root)


def _read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(root)
    return files.select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("json"))


def _local_sidecars(spark: SparkSession, root: str) -> DataFrame:
    hidden = lambda name: name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")  # noqa: E731 - as Spark's readers see it
    wanted = lambda name: name.lower().endswith(".json") and not hidden(name)
    shares, folders = [], [root.rstrip("/") or "/"]  # folder, share, of so many: names aren't kept
    while folders:
        folder, n = folders.pop(), 0
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir():
                    folders += [] if hidden(e.name) else [e.path]
                else:
                    n += wanted(e.name)
        of = -(-n // FILES_A_TASK)
        shares += [(folder, k, of) for k in range(of)]
    most, kept = MOST_BYTES, IN_URI

    def run(batches):
        import zlib

        import pyarrow as pa

        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["file_id", "content"])
        for b in batches:
            for number in b.column(0).to_pylist():
                (folder, share, of), rows, size = shares[number], [], 0
                with os.scandir(folder) as found:
                    for e in found:
                        if not wanted(e.name) or zlib.crc32(os.fsencode(e.name)) % of != share or e.is_dir():
                            continue
                        with open(e.path, "rb") as f:
                            content = f.read()
                        if not content:
                            continue  # Spark's readers have no row for an empty file
                        rows.append(("file:" + kept.sub(lambda m: f"%{ord(m[0]):02X}", e.path), content))
                        size += len(content)
                        if size >= most:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    numbers = spark.range(0, len(shares), 1, max(1, len(shares)))
    return numbers.mapInArrow(run, "file_id string, content binary").select("file_id", F.col("content").cast("string").alias("json"))


def gazetteer(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name of each line that is neither blank nor a comment."""
    return spark.read.text(paths).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')")


def resolved(path: str, package: str | None = None) -> str | None:
    """An absolute path as it is, else one below the package's folder or the current one, if it exists."""
    options = [path] if os.path.isabs(path) else [os.path.join(package or os.path.dirname(os.path.dirname(__file__)), path), os.path.abspath(path)]
    return next((p for p in options if os.path.exists(p)), None)


def name_table(spark: SparkSession, path: str, header: bool = True, column: int | str = 0) -> DataFrame:
    """name: one column of a table of names, trimmed, comments and repeats left out. Tab, comma or semicolon
    separates columns, whichever the first line with text has first in this order."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    line = first[0].value if first else ""
    sep = next((s for s in "\t,;" if s in line), "\x01")
    table = spark.read.option("header", header).option("sep", sep).csv(path)
    names = unique_names([c if header and not re.fullmatch(r"_c\d+", c) else "" for c in table.columns])
    table = table.toDF(*names)
    picked = names[column] if isinstance(column, int) else column
    return table.select(F.trim(F.col(f"`{picked}`")).alias("name")).where("name <> '' and not startswith(name, '#')").distinct()


def unique_names(names: list[str]) -> list[str]:
    """Blank names become `Column i`, later equal ones get a number."""
    out: list[str] = []
    for k, n in enumerate(names, 1):
        base = n.strip() or f"Column {k}"
        name, m = base, 1
        while name in out:
            name, m = f"{base}.{m}", m + 1
        out.append(name)
    return out


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Lines that aren't JSON are left out; fields that a line lacks are null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def labelled_examples(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, EXAMPLES)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, AUDIT)


def processing_log(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, PROCESSING)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
