"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame operations only.

An item's windows are its runs of `window` words, or all its words if it has fewer. A window is contained
in a document only where all its words are, so one word of it is a sufficient prefix: its rarest, by the
number of documents that have it. Documents' words are joined with these words alone. The place of the
rarest word in its window gives where the window would begin; candidates that would begin or end outside
the document are dropped, the others compared word by word.

The join is by keys in simple lower case, the comparison by words whose A-Z alone are lowered; the first
is coarser, and words end at the same places in either.

Windows are written out, so that Spark reads their true size. If it is below `IN_MEMORY` bytes they are
sent to the documents and compared in place; else words and windows are dealt out by key, and documents
are joined again with their candidates.

Cases: null and empty texts have no words; items without words are no items; equal windows count for each
item; rows may repeat; empty tables give zero counts or an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop, written

WINDOW = 8
#: What separates words, in a text whose A-Z are not yet lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IN_MEMORY = 64 << 20


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def item_windows(items: DataFrame, documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """window (its words, lowered, a space between), size, item_id, and key and place of its rarest word: a
    written table."""
    w = items.select(F.col("item_id"), _words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    runs = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("v")).distinct()
    vocabulary = written(runs.select(F.explode("v").alias("x")).select(F.lower("x").alias("key")).distinct(), "vocabulary")
    seen = documents.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("x")).select(F.lower("x").alias("seen"))
    counts = written(seen.join(vocabulary, F.col("seen") == F.col("key")).groupBy("key").agg(F.count("*").alias("n")), "rarity")
    placed = runs.select("item_id", "v", F.posexplode("v").alias("place", "x")).withColumn("key", F.lower("x"))
    rarest = placed.join(counts, "key").groupBy("item_id", "v").agg(F.min(F.struct("n", "key", "place")).alias("r"), F.count("*").alias("found"))
    # A word of the window that no document has rules the window out.
    whole = rarest.where(F.col("found") == F.size("v"))
    out = written(whole.select("item_id", F.array_join("v", " ").alias("window"), F.size("v").alias("size"), F.col("r.key").alias("key"), F.col("r.place").alias("place")), "windows")
    drop(vocabulary, counts)
    return out


def _begin_fits() -> Column:
    return (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))


def _equal() -> Column:
    return ascii_lower(F.array_join(F.slice("w", F.col("start") + 1, F.col("size")), " ")) == F.col("window")


def hits(documents: DataFrame, windows: DataFrame, in_place: bool) -> DataFrame:
    """doc_id, tag (of the text), item_id, start and size of each occurrence of a window."""
    tagged = documents.select("doc_id", F.xxhash64("text").alias("tag"), _words(F.col("text")).alias("w"))
    tagged = tagged.withColumn("n_words", F.size("w"))
    start = F.col("pos") - F.col("place")
    if in_place:
        words = tagged.select("doc_id", "tag", "w", "n_words", F.posexplode("w").alias("pos", "x")).withColumn("own", F.lower("x"))
        met = words.join(F.broadcast(windows), F.col("own") == F.col("key")).withColumn("start", start)
        return met.where(_begin_fits() & _equal()).select("doc_id", "tag", "item_id", "start", "size")
    words = tagged.select("doc_id", "tag", "n_words", F.posexplode("w").alias("pos", "x")).withColumn("own", F.lower("x")).drop("x")
    met = words.join(windows, F.col("own") == F.col("key")).withColumn("start", start).where(_begin_fits())
    candidates = met.select(F.col("doc_id").alias("own_id"), F.col("tag").alias("own_tag"), "item_id", "window", "start", "size").distinct()
    texts = tagged.select("doc_id", "tag", "w").dropDuplicates(["doc_id", "tag"])
    both = candidates.join(texts, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_tag") == F.col("tag")))
    return both.where(_equal()).select("doc_id", "tag", "item_id", "start", "size")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_items: int = 2, in_memory: int = IN_MEMORY) -> DataFrame:
    """doc_id, tag (a hash of the text), n_words, n_hit, n_items, n_full (items of which a window of full size
    occurs), items (sorted, comma-joined) and contaminated of every row."""
    documents = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = item_windows(items.select("item_id", "text").where("text is not null"), documents, window)
    bytes_ = windows.agg(F.sum(F.length("window") * 4 + 80)).first()[0] or 0
    found = written(hits(documents, windows, bytes_ <= in_memory).distinct(), "hits")
    covered = found.select("doc_id", "tag", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct().groupBy("doc_id", "tag").agg(F.count("*").alias("n_hit"))
    listed = found.select("doc_id", "tag", F.col("item_id").cast("string").alias("item"), "size").groupBy("doc_id", "tag", "item").agg((F.max("size") == window).cast("long").alias("full")).groupBy("doc_id", "tag").agg(F.count("*").alias("n_items"), F.sum("full").alias("n_full"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    marks = covered.join(listed, covered["doc_id"].eqNullSafe(listed["doc_id"]) & (covered["tag"] == listed["tag"])).select(covered["doc_id"].alias("hit_id"), covered["tag"].alias("hit_tag"), "n_hit", "n_items", "n_full", "items")
    sizes = documents.select("doc_id", F.xxhash64("text").alias("tag"), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    out = sizes.join(marks, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tag") == F.col("hit_tag")), "left")
    drop(windows)
    n_items = F.coalesce("n_items", F.lit(0))
    return out.select("doc_id", "tag", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), n_items.alias("n_items"), F.coalesce("n_full", F.lit(0)).alias("n_full"), F.coalesce("items", F.lit("")).alias("items"), (n_items >= least_items).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_items: int = 2, least_full: int | None = None) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns. If least_full is given, neither are
    those kept that have windows of full size of so many items."""
    found = contaminated(docs, items, window, least_items)
    gone = F.col("contaminated") if least_full is None else F.col("contaminated") | (F.col("n_full") >= least_full)
    marked = found.where(gone).select(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag")).distinct()
    return docs.join(written(marked, "contaminated"), F.col("doc_id").cast("long").eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("hit_tag")), "left_anti")
