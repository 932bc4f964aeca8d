"""Quality rules: a table of thresholds compiled into one projection, without user functions.

A rule names a measure, the least number of words from which it applies, and its bounds; a document is
kept if it fails neither the base rule nor any rule of the table.

Cases: a null text has no words and is not kept (a rule of length fails it), as is an empty one; rows may
repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

# Common words of the languages of the corpus.
STOP_WORDS = (
    "a and are as at be by for from he in is it not of on or that the this to was when with"
    " au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une"
    " aber auf aus das dem den der des die ein eine für ich im in ist mit nicht sich und von werden zu"
    " al como con del el en es la las lo los más no para por que se su un una y"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Rule(NamedTuple):
    measure: str
    from_words: int
    least: float | None
    most: float | None


#: The default table. Ratios are to words or lines; mean_word is in code points.
RULES = (
    Rule("n_words", 0, 10, None),
    Rule("mean_word", 10, 2.0, 14.0),
    Rule("symbol_ratio", 10, None, 0.3),
    Rule("stop_ratio", 50, 0.02, None),
    Rule("dup_line_ratio", 10, None, 0.4),
)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop and
    n_repeat_words, the words within 5-word windows that the text has twice or more.

    Windows are compared by 64-bit hashes of their words, within one text only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = "".join(map(chr, (32, *range(9, 14))))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", words(F.col("text")).alias("w"), _lines(F.col("text")).alias("l"))
    second = first.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", blank, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    windows = F.when(
        F.size("h") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<long>"))
    third = second.withColumn("g", windows).drop("h")
    # Repeated windows: sorted by hash, those equal to the one before or after; then their places in order.
    pairs = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    fourth = third.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), pairs)).drop("g")
    again = F.filter("s", lambda x, k: ((k > 0) & (F.get("s", k - 1)["g"] == x["g"])) | (F.get("s", k + 1)["g"] == x["g"]))
    fifth = fourth.withColumn("p", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("s")
    # Each window adds the words that the one before it doesn't have.
    covered = F.aggregate(F.transform("p", lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get("p", k - 1)))), F.lit(0), lambda a, x: a + x)
    return fifth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def _measure(name: str) -> Column:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_ratio": F.col("n_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
    }[name]


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table fails."""
    kept = F.lit(True)
    for r in rules:
        x = _measure(r.measure)
        inside = (x >= r.least if r.least is not None else F.lit(True)) & (x <= r.most if r.most is not None else F.lit(True))
        kept &= inside | (F.col("n_words") < r.from_words)
    return kept


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures of every row, base_failed and kept."""
    return measures(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compiled(rules))
