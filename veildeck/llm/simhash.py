"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into few segments. Of two fingerprints that are near, some segment differs by at most
one bit. A segment's exact value is one key; its value with one bit as a wildcard is another, a key for each
bit, and stands on the left side if that bit is 0, on the right if it is 1. Left and right are joined on equal
keys, so that a pair meets where a segment is equal or differs in exactly one bit, and both whole
fingerprints are verified within the join. There are two shapes:

* NARROW: 64 bits of four-word shingles, repeats included, in three segments. Four or five differing bits
  leave one bit at most to some segment, so no link is lost.
* WIDE: 128 bits of the set of five-word shingles, in eight segments of 16 bits, linked at 24 differing bits
  or fewer. Two sets with a Jaccard similarity of 0.8 have vectors 0.475 radians apart, so that a bit
  differs with probability 0.151: 19.4 of 128 bits, with a standard deviation of 4. The bound allows one
  deviation more, and 0.93 of such pairs have a segment that differs by one bit at most.

Beyond `REFINE` distinct fingerprints the narrow shape's keys take exact parts of the other segments as well,
one more part than bits may differ there, so that some part is equal and buckets stay small.

The join runs over distinct fingerprints, so exact copies cost one row however many they are. Of a group of
many near copies not all pairs are made: fingerprints that share two segments, or one, are first linked with
the least of them alone, where that is near enough, and the groups that this gives are found. The join then
puts out only links between different groups. Groups are found by alternating star contractions over the
links, each round a written table.

Cases: a null or empty text, or one of white space only, has fingerprint 0 and is linked like any other;
rows may repeat; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, sized, written


class Shape(NamedTuple):
    """Words in a shingle, 64-bit words of a fingerprint, first bit and width of each segment of such a word,
    and the most differing bits of a link."""

    shingle: int
    words: int
    segments: tuple[tuple[int, int], ...]
    max_bits: int


NARROW = Shape(4, 1, ((0, 21), (21, 21), (42, 22)), 4)
WIDE = Shape(5, 2, tuple((16 * k, 16) for k in range(4)), 24)
SEED = 42
#: Distinct fingerprints from which on keys take parts of the other segments too: a hundred in a bucket.
REFINE = 100 << 20
#: Bits of a key below its segment's value: those of a part, and of the part's number.
PART_BITS, NUMBER_BITS = 12, 3
#: Bytes of keys, about, that one task makes.
TASK_BYTES, KEY_BYTES = 32 << 20, 32


def _grams(text: bytes | None, n: int) -> list[bytes]:
    w = text.lower().split() if text else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False))) if len(w) > n else [b" ".join(w)] if w else []


def _majority(h: np.ndarray) -> np.ndarray:
    """Of hashes, a row of bytes each, the bits that over half of them set, as unsigned words."""
    ones = np.zeros(8 * h.shape[1], np.int64)
    for i in range(0, len(h), 1 << 16):  # the bits of a long text are not all held at once
        ones += np.unpackbits(h[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: bytes | None, shingle: int = NARROW.shingle) -> int:
    """The unsigned narrow fingerprint of one UTF-8 text."""
    grams = _grams(text, shingle)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64, len(grams))
    return int(_majority(h.view(np.uint8).reshape(-1, 8))[0])


def wide_fingerprint(text: bytes | None, shingle: int = WIDE.shingle) -> np.ndarray:
    """The two words of the wide one."""
    h = b"".join(map(partial(xxhash.xxh3_128_digest, seed=SEED), set(_grams(text, shingle))))
    return _majority(np.frombuffer(h, np.uint8).reshape(-1, 16))


def fingerprints(docs: DataFrame, shape: Shape = NARROW) -> DataFrame:
    """doc_id, tag (a hash of the text) and print of every row: a signed long, or a struct of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_py() for t in b.column(1).cast(pa.binary()))
            if shape.words == 1:
                prints = pa.array(np.fromiter((fingerprint(t, shape.shingle) for t in texts), np.uint64, b.num_rows).view(np.int64))
            else:
                both = np.array([wide_fingerprint(t, shape.shingle) for t in texts], np.uint64).reshape(-1, shape.words).view(np.int64)
                prints = pa.StructArray.from_arrays([pa.array(both[:, k]) for k in range(shape.words)], [f"p{k}" for k in range(shape.words)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), prints], ["doc_id", "tag", "print"])

    kind = "long" if shape.words == 1 else "struct<" + ",".join(f"p{k}:long" for k in range(shape.words)) + ">"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tag"))
    return texts.mapInArrow(lean(run), f"doc_id long, tag long, print {kind}")


def _words_of(x: Column, shape: Shape) -> list[Column]:
    return [x] if shape.words == 1 else [x[f"p{k}"] for k in range(shape.words)]


def _segments(x: Column, shape: Shape) -> list[Column]:
    return [F.shiftrightunsigned(word, low).bitwiseAND((1 << width) - 1) for word in _words_of(x, shape) for low, width in shape.segments]


def _keyed(prints: DataFrame, shape: Shape) -> DataFrame:
    """print, mark, key and side: of each segment its exact value (side 2) and one key for each bit (side: the bit)."""
    segments, code = [], 0
    for word in _words_of(F.col("print"), shape):
        for low, width in shape.segments:
            seg = F.shiftrightunsigned(word, low).bitwiseAND((1 << width) - 1)
            segments.append(F.struct(seg.alias("value"), F.lit(width).alias("width"), F.lit(code + 1).alias("code")))
            code += width + 1
    cut = prints.select("print", "mark", F.explode(F.array(*segments)).alias("seg")).select("print", "mark", "seg.*")
    each = cut.select("print", "mark", "value", "code", F.explode(F.sequence(F.lit(-1), F.col("width") - 1)).alias("bit"))
    one = F.expr("if(bit < 0, 0L, shiftleft(1L, bit))")
    value = F.col("value").bitwiseAND(F.bitwise_not(one))
    key = F.shiftleft(value, NUMBER_BITS + PART_BITS).bitwiseOR(F.shiftleft((F.col("code") + F.col("bit")).cast("long"), NUMBER_BITS + PART_BITS + 32))
    side = F.when(F.col("bit") < 0, 2).otherwise((F.col("value") != value).cast("int"))
    return each.select("print", "mark", key.alias("key"), side.alias("side"))


def _refined(keyed: DataFrame, shape: Shape) -> DataFrame:
    """Keys with one exact part of the other segments: of exact keys max_bits + 1 parts, of others one fewer."""
    code, print_ = F.shiftrightunsigned("key", NUMBER_BITS + PART_BITS + 32), F.col("print")
    rest, first = F.lit(0).cast("long"), 0
    for low, width in shape.segments:
        others = F.shiftleft(F.shiftrightunsigned(print_, low + width), low) if low + width < 64 else F.lit(0).cast("long")
        others = others.bitwiseOR(print_.bitwiseAND((1 << low) - 1))
        rest = F.when(code.between(first, first + width), others).otherwise(rest)
        first += width + 1

    def parts(n: int) -> Column:
        size = -(-(64 - min(w for _, w in shape.segments)) // n)
        return F.array(*[F.shiftrightunsigned("rest", size * k).bitwiseAND((1 << size) - 1).bitwiseOR(k << PART_BITS) for k in range(n)])

    exact = F.col("side") == 2
    made = keyed.withColumn("rest", rest).withColumn("part", F.explode(F.when(exact, parts(shape.max_bits + 1)).otherwise(parts(max(1, shape.max_bits)))))
    return made.select("print", "mark", F.col("key").bitwiseOR(F.col("part")).alias("key"), "side")


def _near(a: Column, b: Column, shape: Shape) -> Column:
    differ = [F.bit_count(p.bitwiseXOR(q)) for p, q in zip(_words_of(a, shape), _words_of(b, shape), strict=True)]
    return sum(differ[1:], differ[0]) <= shape.max_bits


def _tasks(distinct: DataFrame, n: int, keys: int) -> int:
    """A number of partitions of our own: each print becomes a row for each key, which Spark's estimate leaves out."""
    return max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * keys * KEY_BYTES // TASK_BYTES)


def stars(distinct: DataFrame, n: int, shape: Shape) -> DataFrame:
    """Links a < b of the n distinct fingerprints with the least one of those that share a segment, or two, with
    them, where it is near: a row for each cell at most, however large a group is."""
    seg = _segments(F.col("print"), shape)
    cells = [F.xxhash64(F.lit(i), x) for i, x in enumerate(seg)] + [F.xxhash64(F.lit(i), x, F.lit(j), y) for i, x in enumerate(seg) for j, y in enumerate(seg[:i])]
    each = distinct.repartition(_tasks(distinct, n, len(cells))).select("print", F.explode(F.array(*cells)).alias("cell"))
    least = written(each.groupBy("cell").agg(F.min("print").alias("least"), F.count("*").alias("n")).where("n > 1").select("cell", "least"), "cells")
    met = each.join(sized(least, least.count()), "cell").where((F.col("print") != F.col("least")) & _near(F.col("print"), F.col("least"), shape))
    out = written(met.select(F.col("least").alias("a"), F.col("print").alias("b")).distinct(), "stars")
    drop(least)
    return out


def _pairs(rows: DataFrame, n: int, shape: Shape, refine: int) -> DataFrame:
    """Pairs a < b of the n rows (print, mark) that are near and differ in their marks."""
    if shape.words == 1 and not 0 <= shape.max_bits <= 2 * len(shape.segments) - 1:
        raise ValueError("one of three segments differs by one bit at most only up to five bits")
    keys = shape.words * (64 + len(shape.segments))
    keyed = _keyed(rows.repartition(_tasks(rows, n, keys)), shape)
    if shape.words == 1 and n > refine:
        keyed = _refined(keyed, shape)
    a = keyed.where("side <> 1").select(F.col("print").alias("a"), F.col("mark").alias("own"), "key", F.col("side").alias("left"))
    b = keyed.where("side <> 0").select(F.col("print").alias("b"), F.col("mark").alias("other"), F.col("key").alias("to"))
    met = a.join(sized(b, n * keys), (F.col("key") == F.col("to")) & (F.col("own") != F.col("other")) & ((F.col("left") == 0) | (F.col("a") < F.col("b"))) & _near(F.col("a"), F.col("b"), shape))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(prints: DataFrame, shape: Shape = NARROW, refine: int = REFINE) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column print) that differ in at most shape.max_bits bits."""
    distinct = written(prints.select("print").distinct().withColumn("mark", F.xxhash64("print")), "distinct")
    return _pairs(distinct, distinct.count(), shape, refine)


def groups(prints: DataFrame, shape: Shape = NARROW, refine: int = REFINE) -> DataFrame:
    """print and root (of its group) of each distinct fingerprint: a written table."""
    distinct = written(prints.select("print").distinct(), "distinct")
    n = distinct.count()
    star = stars(distinct, n, shape)
    first = components(star)
    # The mark is a hash of the group, which is all that the join has to tell apart.
    rooted = written(distinct.join(sized(first, 2 * star.count()), F.col("print") == F.col("node"), "left").select("print", F.coalesce("root", "print").alias("root")).withColumn("mark", F.xxhash64("root")), "rooted")
    drop(star, first, distinct)
    pairs = written(_pairs(rooted.select("print", "mark"), n, shape, refine), "pairs")
    root = rooted.select("print", "root")
    found = pairs.count()
    ends = pairs.join(sized(root.toDF("a", "root_a"), found), "a").join(sized(root.toDF("b", "root_b"), found), "b")
    second = components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    out = written(rooted.select("print", F.col("root").alias("first")).join(sized(second, 2 * found), F.col("first") == F.col("node"), "left").select("print", F.coalesce("root", "first").alias("root")), "roots")
    drop(rooted, pairs, second)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the smallest node that it reaches, for every node of the edges a, b.

    Large-star and small-star steps in turn (Kiveris and others, 2014) until nothing changes. Each is a
    grouped minimum and a join; the minimum is written first, so that the rows of a node with very many
    neighbours come straight from an exchange and can be split.
    """
    both = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    n, seen = both.count(), None
    for _ in range(rounds):
        sym = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = written(sym.where("v > u").join(sized(low, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(sized(lower, 2 * n), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        after = written(small.distinct(), "edges")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop(both, low, large, lower)
        both = after
        if now == seen:
            break
        n, seen = now[0], now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return both.select(F.col("u").alias("node"), F.col("v").alias("root")).union(both.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, shape: Shape = NARROW) -> DataFrame:
    """Of every row doc_id, tag (a hash of its text), print, root (its group) and component_id, the smallest
    doc_id of the group (null if no row of it has one)."""
    prints = written(fingerprints(docs, shape), "prints")
    roots = groups(prints, shape)
    n = roots.count()
    least = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")).join(sized(roots, n), "print"), "least")
    # Written on its own, so that the rows of a very large group come straight from an exchange and can be split.
    first = written(least.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    ids = written(least.join(sized(first, first.count()), "root").select("print", "root", "component_id"), "ids")
    drop(least, first, roots)
    return prints.join(sized(ids, n), "print").select("doc_id", "tag", "print", "root", "component_id")


def representatives(docs: DataFrame, shape: Shape = WIDE) -> DataFrame:
    """The rows of docs that stay if one of each group does: that of the smallest doc_id, without an id only
    where no row of the group has one. All columns stay."""
    found = written(near_duplicates(docs, shape), "groups")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first"))
    stay = written(first.select(F.col("first.doc_id").alias("stay_id"), F.col("first.tag").alias("stay_tag")), "stay")
    n = stay.count()
    stay = sized(stay, n)
    again = found.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("tag") == F.col("stay_tag"))).count() > n
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("stay_id")) & (F.xxhash64("text") == F.col("stay_tag"))
    kept = docs.join(stay, here, "left_semi")
    drop(found)
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept  # only rows that repeat are in excess


def hexed(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))
