"""JSON sidecars: known values, per-key actions, scrubbing, counts, and the join with their volumes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import pseudonyms as P
from ..functions import spans as S
from ..plans import catalog as C
from .elements import filename_parts, identifier_tokens


def stem(path: Column) -> Column:
    """The file name without folders and extension."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return filename_parts(name)[0]


def entries(sidecars: DataFrame) -> DataFrame:
    """file_id, key, raw, text, is_text of each key of an object; other JSON gives one row with a null key,
    and malformed text one with skipped. Columns in: file_id, json."""
    v = sidecars.select("file_id", "json", F.try_parse_json("json").alias("v"))
    kind = F.when(F.col("v").isNull(), "skipped").when(F.schema_of_variant("v").startswith("OBJECT"), "object").otherwise("other")
    kinds = v.select("file_id", "json", kind.alias("kind"))
    pairs = kinds.where("kind = 'object'").select("file_id", "kind", F.explode(F.from_json("json", "map<string,string>")).alias("key", "raw"))
    pairs = pairs.withColumn("is_text", F.lit(None).cast("boolean"))
    rest = kinds.where("kind <> 'object'").select("file_id", "kind", F.lit(None).cast("string").alias("key"), F.col("json").alias("raw"), F.lit(None).cast("boolean").alias("is_text"))
    return pairs.unionByName(rest)


def known_values(rows: DataFrame) -> DataFrame:
    """file_id, known: identifiers of the keys that hold them, whole and in parts. rows from entries()."""
    held = rows.where(F.col("key").isin(*C.JSON_KNOWN_KEYS) & F.col("raw").isNotNull())
    values = F.coalesce(F.from_json("raw", "array<string>"), F.array("raw"))
    return held.select("file_id", F.explode(values).alias("v")).select("file_id", F.explode(identifier_tokens(F.col("v"))).alias("t")).groupBy("file_id").agg(F.array_sort(F.collect_set("t")).alias("known"))


def deidentified(rows: DataFrame, key_actions: DataFrame, salt: DataFrame, scanner: D.Scanner | None = None, low: int = -365, high: int = 365) -> DataFrame:
    """file_id, key, action, result (null if the key goes), n_removed, n_shifted, n_scrubbed of each entry.

    Strings are scanned with the file's own identifiers; a value that is itself an array or object is
    scanned as its JSON text."""
    person = rows.where(F.col("key").isin("PatientID", "PatientName")).groupBy("file_id").agg(F.max(F.when(F.col("key") == "PatientID", F.nullif("raw", F.lit("")))).alias("i"), F.max(F.when(F.col("key") == "PatientName", F.col("raw"))).alias("n"))
    person = person.select("file_id", F.coalesce("i", "n", F.lit("")).alias("patient"))
    full = rows.join(F.broadcast(key_actions.withColumnRenamed("keyword", "key")), "key", "left").join(known_values(rows), "file_id", "left").join(person, "file_id", "left").crossJoin(F.broadcast(salt.toDF("salt")))
    gone = F.coalesce(F.col("action").isin("X", "Z", "D", "H", "U"), F.lit(False))
    days = P.date_offset(F.coalesce("patient", F.lit("")), F.col("salt"), low, high)
    moved = F.when(F.col("action") == "S", P.shifted_iso(F.col("raw"), days))
    text = full.withColumn("moved", moved).withColumn("scan_text", F.when(~gone & F.col("moved").isNull() & ~F.coalesce(F.col("action") == "K", F.lit(False)), F.col("raw")))
    done = D.redacted(text, "scan_text", scanner or D.Scanner(), "known", "[REDACTED]", "clean")
    result = F.when(gone, F.lit(None).cast("string")).otherwise(F.coalesce("moved", "clean", "raw"))
    hits = F.when(F.col("scan_text").isNotNull(), F.size("spans")).otherwise(0)
    shifting = F.coalesce(F.col("action") == "S", F.lit(False))
    return done.where("kind <> 'skipped'").select(
        "file_id", "key", "action", result.alias("result"), gone.cast("long").alias("n_removed"), F.when(shifting, hits + F.col("moved").isNotNull().cast("int")).otherwise(0).cast("long").alias("n_shifted"), F.when(shifting, 0).otherwise(hits).cast("long").alias("n_scrubbed")
    )


def counts(done: DataFrame) -> DataFrame:
    return done.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in ("n_removed", "n_scrubbed", "n_shifted")])


def volumes_with_known(volumes: DataFrame, rows: DataFrame, paths: DataFrame) -> DataFrame:
    """volumes (path) with the identifiers of the sidecar of the same stem; null where there is none."""
    by_stem = known_values(rows).join(paths, "file_id").select(stem(F.col("path")).alias("stem"), "known")
    by_stem = by_stem.groupBy("stem").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("known")))).alias("known"))
    return volumes.withColumn("stem", stem(F.col("path"))).join(by_stem, "stem", "left")


def scrubbed_tree(sidecars: DataFrame, scan) -> DataFrame:
    """file_id, clean, n: JSON of any shape with every string rewritten by scan(text) -> (text, hits).

    Built-in functions can't walk values of unknown depth, so this one goes through Arrow batches."""
    import json

    def walk(x):
        if isinstance(x, str):
            return scan(x)
        if isinstance(x, list):
            got = [walk(y) for y in x]
            return [y for y, _ in got], sum(n for _, n in got)
        if isinstance(x, dict):
            got = {k: walk(y) for k, y in x.items()}
            return {k: y for k, (y, _) in got.items()}, sum(n for _, n in got.values())
        return x, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean, hits = [], []
            for t in b.column(1).to_pylist():
                try:
                    x, n = walk(json.loads(t))
                    clean.append(json.dumps(x, ensure_ascii=False))
                    hits.append(n)
                except (TypeError, ValueError):
                    clean.append(None)
                    hits.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string()), pa.array(hits, pa.int64())], ["file_id", "clean", "n"])

    return sidecars.select("file_id", "json").mapInArrow(run, "file_id string, clean string, n long")


def spans_as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["category"], s["start"].cast("string"), s["end"].cast("string"))), ",")


