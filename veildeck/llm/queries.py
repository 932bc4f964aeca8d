"""The thin queries over the driver's tables, one an operator, with the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn, decontaminate, langid, mincut, packing, ppm, quality, secrets, simhash, sql, urlrules
from .common import table

# The rules of op2.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# The longest context of op3, in bytes.
LM_ORDER = 4


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents"), LM_ORDER)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extracted(table(spark, sf_dir, "pages"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scanned(docs, secrets.Scanner(secrets.ordinary_strings(docs))).drop("redacted_text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profile = langid.profiles(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), profile)
    return found.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("print")).alias("fingerprint"), "component_id")


def queries() -> dict:
    ops = (op1_quality_rules, op2_url_filters, op3_lm_scoring, op4_packing, op5_html_extraction, op6_secret_scans, op7_substring_dedup, op8_language_id, op9_decontamination, op10_simhash)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": sql.quality(), "op2_url_filters": sql.urls(URL_RULES), "op7_substring_dedup": sql.SUBSTRINGS, "op9_decontamination": sql.DECONTAMINATION}
