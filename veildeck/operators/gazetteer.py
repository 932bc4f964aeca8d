"""Names of lists of any length in texts: an equi-join on a name's first word, then a check of the phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S

WORD = r"[\p{L}\p{N}_]+"


def hits(texts: DataFrame, names: DataFrame) -> DataFrame:
    """key, start, end, text of each name (column name) in each text (columns key, text): whole phrases, in
    any case. Words and names are dealt out by the word, so neither list need fit into memory; a word's row
    has its place, not its text. Candidates alone are joined with their texts again."""
    rows = texts.where("text is not null").select("key", "text").withColumn("row", F.xxhash64("key", "text"))
    listed = names.select(F.trim("name").alias("name")).where("name <> ''").select(F.lower("name").alias("name")).distinct()
    first = listed.select("name", F.lower(F.regexp_extract("name", rf"({WORD})", 1)).alias("first"), (F.regexp_instr("name", F.lit(WORD)) - 1).alias("lead")).where("first <> ''")
    met = _words(rows).join(first, F.col("word") == F.col("first")).select("row", F.col("key").alias("own"), (F.col("at") - F.col("lead")).alias("start"), "name").where("start >= 0").distinct()
    found = met.join(rows.withColumnRenamed("row", "of"), (F.col("row") == F.col("of")) & F.col("own").eqNullSafe(F.col("key"))).withColumn("end", F.col("start") + F.length("name"))
    same = F.lower(F.substring(F.col("text"), F.col("start") + 1, F.length("name"))) == F.col("name")
    before, after = F.substring(F.col("text"), F.col("start"), F.lit(1)), F.substring(F.col("text"), F.col("end") + 1, F.lit(1))
    is_word = lambda c: c.rlike(r"[\p{L}\p{N}_]")
    edge = lambda inner, outer: is_word(inner) != is_word(outer)
    head, tail = F.substring(F.col("name"), F.lit(1), F.lit(1)), F.expr("substr(name, length(name), 1)")
    outer_before = F.when(F.col("start") == 0, "").otherwise(before)
    return found.where(same & edge(head, outer_before) & edge(tail, after)).select("key", "start", "end", F.expr("substr(text, start + 1, length(name))").alias("text")).distinct()


def _words(rows: DataFrame) -> DataFrame:
    """row, key, at, word: every word of a text in lower case with its place."""
    parts = F.regexp_extract_all("text", F.lit(rf"({WORD}|[^\p{{L}}\p{{N}}_]+)"), F.lit(1))
    # The place is the length of what stands before: ends of all parts, then each part's own length off its end.
    return rows.select("row", "key", F.explode(_placed(parts)).alias("w")).where(F.col("w.word").rlike(rf"^{WORD}$")).select("row", "key", "w.at", F.lower("w.word").alias("word"))


def _placed(parts: Column) -> Column:
    """at and word of each part. Blocks of 256 parts are summed first, so that no sum runs over all before."""
    size = 256
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    starts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts), F.lit(size))).otherwise(F.array().cast("array<int>"))

    def block(own: Column, base: Column) -> Column:
        return F.transform(own, lambda x, j: F.struct((base + total(F.slice(own, 1, j))).alias("at"), x.alias("word")))

    def whole(blocks: Column) -> Column:
        return S.let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(blocks, lambda own, k: S.let(F.aggregate(F.slice(sums, 1, k), F.lit(0), lambda a, n: a + n), lambda base: block(own, base)))))

    return S.let(F.transform(starts, lambda i: F.slice(parts, i, size)), whole)
