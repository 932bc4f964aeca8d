"""From documents to packed sequences: five stages, each written as Parquet and read again.

1. language: documents without a letter, or unlike every learned language, go; where nothing could be
   learned, those with a letter stay.
2. near_duplicates: one document of each group of near copies stays (wide fingerprints of five-word shingles,
   for a similarity of 0.8 or more).
3. decontamination: documents with a passage of eight words of a benchmark item go, and those with two items;
   an item of fewer words alone, which may be a common phrase, drops none.
4. secrets: what the scan finds is replaced within the text; every document stays.
5. packing: the pieces of the packed sequences.

All stages but the last return the columns of documents. Each begins with room for its Python workers, as heaps keep
what the stage before it needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veildeck.llm import decontaminate, langid, packing, secrets, simhash
from veildeck.llm.common import MADE, ready, sweep, table, written
from veildeck.llm.queries import tokenizer_path

#: Documents that share less than this of their n-gram ranks with the nearest language are rejected.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    profiles = langid.profiles(docs)
    found = langid.identified(docs, profiles)
    if not profiles:
        return found.where(F.col("row.text").rlike(r"\p{L}")).select("row.*")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.representatives(docs, simhash.WIDE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), least_full=1)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return secrets.without_secrets(docs, secrets.Scanner(secrets.ordinary_strings(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.packed(docs, tokenizer_path(), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("packing", pack)]

#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's own tables, and the one that it read, are deleted once its result is written."""
    docs, since = table(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        sweep(spark, since, MADE[-1])
    return docs
