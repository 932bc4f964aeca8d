"""Removal of repeated word sequences by compaction of a sampled de Bruijn graph.

A window is `window` consecutive words; it is repeated if its word sequence starts anywhere else too.
The edges of the graph are word k-mers. Of each window's k-mers one, the minimizer, stands for it, so
that an occurrence of an edge owns a run of successive windows: a stretch, known by one hash of its words,
with its source coordinates and the stretches before and after it. Spark joins and aggregates do the rest:

1. an edge that occurs once owns no repeated window;
2. a stretch that occurs twice or more is a node of the repeated graph, all its windows are repeated. Its
   in-degree is the number of stretches that come before it, a document's start among them, its out-degree
   likewise. Where a node has one successor, which has it as its one predecessor, the path doesn't branch.
   Such paths are compacted by pointer doubling: each round joins the nodes with their predecessors'
   pointers, until every node knows its path's head. A path then has one row for each of its occurrences;
3. an edge at which different stretches meet is a branch: their words part somewhere within them. One
   source of each is read again and its windows are compared one by one, by 128-bit digests;
4. one source of each path is read again at its coordinates for a digest of its words; whatever is to be
   removed from a text is compared there with that digest first, and stays if it differs.

So rows are per edge occurrence (2 in 25 words), not per word, and copies of one text meet only in
counts. A row is known by a 64-bit hash of its id and text, which the digests of step 4 confirm.

Cases: a null, empty or short text has no window; a row that repeats another one, id included, counts as
another document; a doc_id may be null or stand for several texts; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

WINDOW = 35
EDGE = 12
#: An odd multiplier of the rolling hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words hashed at once; a longer text is cut into sections, whose windows still cover all of it.
BLOCK = 1 << 20
PLACE_BITS = 24
KEPT_HASHES = 1 << 20


class _WordHashes(dict):
    """64-bit hashes of words, kept for words that come again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_HASHES:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def _powers(x: int, n: int) -> np.ndarray:
    p = np.full(n, x, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Rolling:
    """Hashes of word ranges from prefix sums, alike wherever the range stands."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(BASE, n), out=self.sums[1:])
        self.back = _powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def each(self, length: int) -> np.ndarray:
        """Of every range of that length."""
        return (self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` successive entries."""
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def stretches(hashes: np.ndarray, doc: np.ndarray, window: int, edge: int) -> tuple[np.ndarray, ...]:
    """edge hash, stretch hash, first window and number of windows of each edge occurrence.

    doc says which document each word belongs to; a window lies within one.
    """
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none.view(np.uint64), none.view(np.uint64), none, none
    roll = Rolling(hashes)
    edges = roll.each(edge)
    low = np.uint64((1 << PLACE_BITS) - 1)
    rank = (_mixed(edges) & ~low) | np.arange(len(edges), dtype=np.uint64)  # the leftmost of equal ones
    place = (_least(rank, window - edge + 1) & low).astype(np.int64)
    at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    if not len(at):
        return none.view(np.uint64), none.view(np.uint64), none, none
    own = place[at]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
    first, last = at[new], at[np.r_[new[1:], len(at)] - 1]
    return edges[own[new]], roll.of(first, last + window), first, last - first + 1


def _blocks(rows: Iterator[tuple], cache: _WordHashes, window: int) -> Iterator[tuple]:
    """hashes, doc, and per doc: its row hash, the place of its first word here and in its text."""
    hashes: list[int] = []
    lengths: list[int] = []
    parts: list[tuple] = []
    for row, w in rows:
        for start in range(0, max(1, len(w) - window + 1), BLOCK):
            piece = w[start : start + BLOCK + window - 1]
            parts.append((row, len(hashes), start))
            lengths.append(len(piece))
            hashes += [cache[x] for x in piece]
            if len(hashes) >= BLOCK:
                yield np.array(hashes, np.uint64), np.repeat(np.arange(len(parts)), lengths), parts
                hashes, lengths, parts = [], [], []
    if parts:
        yield np.array(hashes, np.uint64), np.repeat(np.arange(len(parts)), lengths), parts


def _edge_rows(window: int, edge: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()

        def rows():
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                    text = t.as_py()
                    if text and len(w := text.split()) >= window:
                        yield i, w

        for hashes, doc, parts in _blocks(rows(), cache, window):
            edges, whole, first, count = stretches(hashes, doc, window, edge)
            d = doc[first]
            ids = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(d))
            here, start = (np.array(x, np.int64)[d] for x in ([p[1] for p in parts], [p[2] for p in parts]))
            path = whole.view(np.int64)
            follows = np.r_[False, d[1:] == d[:-1]][: len(d)]
            before = pa.array(np.r_[0, path[:-1]][: len(d)], pa.int64(), mask=~follows)
            after = pa.array(np.r_[path[1:], 0][: len(d)].astype(np.int32), pa.int32(), mask=~np.r_[follows[1:], False][: len(d)])
            yield pa.RecordBatch.from_arrays([pa.array(edges.view(np.int64)), pa.array(path), ids, pa.array(_spot(first - here + start, count)), before, after], FOUND_NAMES)

    return run


FOUND = "edge long, stretch long, row long, at long, before long, after int"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]
#: A place is a first window and a number of windows: those of one stretch are fewer than 256.
COUNT_BITS = 8


def _spot(start, count):
    return start << COUNT_BITS | count


class Normal:
    """A text's words with a space between, and the digests of ranges of them."""

    def __init__(self, words: list[bytes]):
        self.text = b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()

    def digest(self, start: int, end: int) -> bytes:
        return xxhash.xxh3_128_digest(self.text[self.ends[start - 1] if start else 0 : self.ends[end - 1] - 1])


def _read_rows(window: int):
    """Of the sources listed with each text: a path's digest, and the windows of a branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for b in batches:
            edges, digests, ids, ats, many, heads = [], [], [], [], [], []
            for i, t, spots in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                w = (t.as_py() or b"").split()
                normal = Normal(w)
                for s in spots:
                    start, count = s["start"], s["windows"]
                    end = start + count + window - 1
                    if end > len(w):
                        continue  # of another text with the same row hash
                    if s["head"] is not None:
                        own = normal.digest(start, end)
                        for column, x in zip((edges, digests, ids, ats, many, heads), (None, own, i, start, False, s["head"]), strict=True):
                            column.append(x)
                        continue
                    roll = Rolling(np.array([cache[x] for x in w[start:end]], np.uint64))
                    if int(roll.of(np.array([0]), np.array([end - start])).view(np.int64)[0]) != s["stretch"]:
                        continue
                    edges += [s["edge"]] * count
                    digests += [normal.digest(k, k + window) for k in range(start, start + count)]
                    ids += [i] * count
                    ats += range(start, start + count)
                    many += [s["many"]] * count
                    heads += [None] * count
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(edges, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64()), pa.array(ats, pa.int64()), pa.array(many, pa.bool_()), pa.array(heads, pa.int64())], READ_NAMES)

    return run


READ = "edge long, one long, two long, row long, start long, many boolean, head long"
READ_NAMES = [x.split()[0] for x in READ.split(", ")]


def _rows(docs: DataFrame) -> DataFrame:
    """row (a hash of id and text), doc_id and text."""
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def path_heads(nodes: DataFrame) -> DataFrame:
    """node and head for the rows node, before (its one predecessor, or null), after (the low 32 bits of its
    one successor, or null): the first node of its nonbranching path. Pointer doubling, a written table a round."""
    up = nodes.select(F.col("node").alias("u"), F.col("after").alias("u_after"))
    low = F.col("node").bitwiseAND(0xFFFFFFFF)
    straight = nodes.join(up, (F.col("before") == F.col("u")) & (F.col("u_after").cast("long").bitwiseAND(0xFFFFFFFF) == low), "left")
    now = written(straight.select("node", F.coalesce("u", "node").alias("head"), F.col("u").isNull().alias("done")), "paths")
    for _ in range(64):
        if now.where("not done").isEmpty():
            return now.select("node", "head")
        there = now.select(F.col("node").alias("u"), F.col("head").alias("u_head"), F.col("done").alias("u_done"))
        moved = now.where("not done").join(there, F.col("head") == F.col("u")).select("node", F.col("u_head").alias("head"), F.col("u_done").alias("done"))
        after = written(now.where("done").unionByName(moved), "paths")
        drop(now)
        now = after
    raise RuntimeError("a path of the graph has no head")


def repeated(docs: DataFrame, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """row, start, windows and one (half a digest of the words): runs of repeated windows."""
    if not 1 <= edge <= window or window - edge >= 255:
        raise ValueError("an edge is at most as long as a window, and not over 254 words shorter")
    texts = _rows(docs)
    found = written(texts.select("row", "text").mapInArrow(_edge_rows(window, edge), FOUND), "edges")
    # What is joined is written first: both sides then come straight from an exchange, and Spark can split
    # the rows of a very common edge.
    twice = written(found.groupBy("edge").count().where("count > 1").select("edge"), "twice")
    shared = written(found.join(twice, "edge", "left_semi"), "shared")
    drop(found, twice)
    one = lambda x: F.when((F.min(x) == F.max(x)) & (F.count(x) == F.count("*")), F.min(x)).alias(x)
    kinds = written(shared.groupBy("edge", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("source"), one("before"), one("after")), "stretches")
    start, count = F.shiftright("source.at", COUNT_BITS), F.col("source.at").bitwiseAND((1 << COUNT_BITS) - 1)
    nodes = written(kinds.where("n > 1").select(F.col("stretch").alias("node"), "before", "after", F.col("source.row").alias("row"), start.alias("start"), count.alias("windows")), "nodes")
    heads = path_heads(nodes.select("node", "before", "after"))
    lengths = heads.join(nodes.select("node", "windows"), "node").groupBy("head").agg(F.sum("windows").alias("windows"))
    paths = nodes.select(F.col("node").alias("head"), "row", "start").join(lengths, "head")
    branches = written(kinds.groupBy("edge").agg(F.min("n").alias("least"), F.count("*").alias("ways")).where("ways > 1 and least = 1").select("edge"), "branches")
    none = F.lit(None).cast("long")
    parted = kinds.join(branches, "edge", "left_semi").select(F.col("source.row").alias("row"), F.struct(start.alias("start"), count.alias("windows"), none.alias("head"), "edge", "stretch", (F.col("n") > 1).alias("many")).alias("spot"))
    straight = paths.select("row", F.struct("start", "windows", "head", none.alias("edge"), none.alias("stretch"), F.lit(False).alias("many")).alias("spot"))
    spots = written(parted.unionByName(straight), "spots").groupBy(F.col("row").alias("spot_row")).agg(F.collect_set("spot").alias("spots")).hint("shuffle_hash")
    read = written(texts.join(spots, F.col("row") == F.col("spot_row")).select("row", "text", "spots").mapInArrow(_read_rows(window), READ), "windows")
    confirmed = written(read.where("head is not null").groupBy("head").agg(F.min("one").alias("one")).join(lengths, "head"), "confirmed")
    whole = shared.join(confirmed, F.col("stretch") == F.col("head")).select("row", F.shiftright("at", COUNT_BITS).alias("start"), "windows", "one")
    single = read.where("head is null")
    met = written(single.groupBy("edge", "one", "two").agg((F.count("*") + F.sum(F.col("many").cast("int"))).alias("n")).where("n > 1").select("edge", "one", "two"), "met")
    parts = single.where("not many").join(met, ["edge", "one", "two"], "left_semi").select("row", "start", F.lit(1).cast("long").alias("windows"), "one")
    out = written(whole.unionByName(parts), "repeated")
    drop(shared, kinds, nodes, heads, branches, read, confirmed, met)
    return out


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, gone, digests, kept_texts = [], [], [], []
            for t, runs in zip(b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                w = (t.as_py() or b"").split()
                kept = w
                if runs:
                    normal = Normal(w)
                    turns = np.zeros(len(w) + 1, np.int64)
                    for r in runs:
                        start, end = r["start"], r["start"] + r["windows"] + window - 1
                        if end <= len(w) and int.from_bytes(normal.digest(start, end)[:8], "little", signed=True) == r["one"]:
                            turns[start] += 1
                            turns[end] -= 1
                    keep = np.cumsum(turns[:-1]) == 0
                    kept = [w[i] for i in np.flatnonzero(keep)]
                joined = b" ".join(kept)
                counts.append(len(w))
                gone.append(len(w) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (the kept words, a space between) of every row."""
    runs = repeated(docs, window, edge).groupBy(F.col("row").alias("run_row")).agg(F.collect_set(F.struct("start", "windows", "one")).alias("runs")).hint("shuffle_hash")
    both = _rows(docs).join(runs, F.col("row") == F.col("run_row"), "left").select("doc_id", "text", "runs")
    return both.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
