"""Token packing along a space-filling curve.

Each document's token ids are hashed into a few counts, projected to three dimensions with fixed signs,
and given the Hilbert key of that point. Documents are sorted by key over ranges of about `RANGE_BYTES` of
ids (equal keys by id, then by a salt, so a group of equal rows may span ranges), and each range is laid out
as one stream that is cut at every `size` ids. What remains at a range's end is cut into powers of two,
which need no padding. Where ranges begin is read off a sample of rows, drawn by their size; it decides only
who does the work.

Ids are those of the tokenizer file through `tokenizers`. A text is cut before each single space that
stands before a word; the pre-tokenizer cuts there too, so the ids of the pieces are the text's ids, and
pieces that come again are looked up. A new piece of plain Latin letters is one pre-token, which the
tokenizer's model gets as it is; ASCII punctuation after it is another; other pieces go through the whole
tokenizer. Texts or files to which that doesn't
apply are encoded whole.

Cases: a null or empty text is the one id 0; rows may repeat, each is packed; a null id is kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, release, written

SIZE = 1024
END_ID = 0
BUCKETS = 32
BITS = 10
#: Pieces kept by a worker, in each of two generations: some 160 MB.
KEPT_PIECES = 3 << 17
#: Letters below this code point have been letters in all versions of Unicode since 5.0.
PLAIN_BELOW = "\u0250"
#: Bytes of ids in a range, about; rows sampled for each, and in all.
RANGE_BYTES, PER_RANGE, SAMPLE = 64 << 20, 60, 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Kept(dict):
    """Encoded strings, kept for when they come again. When full, it is put aside as the old generation, from
    which what is still in use comes back, and the generation before is dropped."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, x: str) -> bytes:
        got = self.old.get(x)
        if got is None:
            got = self.encode(x)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[x] = got
        return got


class Encoder:
    """Token ids of texts as little-endian unsigned numbers, two bytes each where all ids fit."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = str(self.tokenizer.pre_tokenizer)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)["model"].get("type")
        # Cutting at spaces is right for plain byte-level files only.
        self.cuts = kind == "BPE" and pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre and self.tokenizer.normalizer is None
        self.alphabet = {b: c for c, b in _byte_alphabet().items()}
        self.first = _Kept(self._piece, KEPT_PIECES >> 4)
        self.rest = _Kept(lambda x: self._piece(" " + x), KEPT_PIECES)
        self.marks_after = _Kept(self._piece, KEPT_PIECES >> 4)

    def _piece(self, x: str) -> bytes:
        """Of a word at a text's start, or of one with the space before it."""
        word, own = (x[1:], self.rest) if x[:1] == " " else (x, self.first)
        if word.isalpha():
            if word.isascii():
                return array(self.code, [t.id for t in self.tokenizer.model.tokenize("Ġ" + word if own is self.rest else word)]).tobytes()
            if max(word) < PLAIN_BELOW:
                return array(self.code, [t.id for t in self.tokenizer.model.tokenize(x.encode().decode("latin-1").translate(self.alphabet))]).tobytes()
        elif (core := word.rstrip(string.punctuation)) != word and core.isalpha() and max(core) < PLAIN_BELOW:
            return own[core] + self.marks_after[word[len(core) :]]
        return array(self.code, self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cuts or "  " in text or text[-1:] == " " or any(m in text for m in self.marks):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        pieces = text.split(" ")
        first = pieces.pop(0)
        return (self.first[first] if first else b"") + b"".join(map(self.rest.__getitem__, pieces))


def _encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps what it has learnt from task to task."""
    import sys
    import types

    kept = sys.modules.setdefault("_veildeck_encoders", types.ModuleType("_veildeck_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def _forget() -> None:
    """Frees what a worker has learnt: texts are encoded before any sequence is laid out."""
    import sys

    if kept := sys.modules.get("_veildeck_encoders"):
        for x in list(vars(kept).values()):
            if hasattr(x, "rest"):
                for cache in (x.first, x.rest, x.marks_after):
                    cache.clear()
                    cache.old = {}
    release()


def hilbert(point: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place along the Hilbert curve of points in unsigned coordinates, a row each (Skilling, 2004)."""
    x = point.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """A Hilbert key for each sequence of ids, from its hashed and normalized id counts."""
    counts = np.stack([np.bincount((i.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(27), minlength=BUCKETS) for i in ids]).astype(float)
    unit = counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    signs = np.random.default_rng(7).choice([-1.0, 1.0], (BUCKETS, 3))
    # Norm-one vectors of 32 counts lie mostly within this range; what lies outside goes to its ends.
    place = (unit @ signs + 2) / 4
    return hilbert(np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([END_ID], encoder.dtype).tobytes()
        for big in batches:
            for start in range(0, big.num_rows, 512):
                b = big.slice(start, 512)
                ids = [encoder.encode(t or "") + end for t in b.column(1).to_pylist()]
                keys = curve_keys([np.frombuffer(x, encoder.dtype) for x in ids])
                wide = pa.array([encoder.dtype.itemsize] * len(ids), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys), wide, pa.array(ids, pa.binary())], ["doc_id", "key", "width", "ids"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _laid_out(size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        part = TaskContext.get().partitionId()
        sequence, open_ = part << 40, []  # the pieces of the sequence that isn't full yet
        filled = 0

        def rows(pieces):
            cols = list(zip(*pieces, strict=True)) if pieces else [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            out = []
            for i, width, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                x = np.frombuffer(ids.as_py(), f"<u{width}").astype("<u4")
                start = 0
                while start < len(x):
                    n = min(size - filled, len(x) - start)
                    open_.append((i, start, n, x[start : start + n], len(x), filled))
                    start, filled = start + n, filled + n
                    if filled == size:
                        out += [_piece(p, sequence, with_ids) for p in open_]
                        sequence, open_, filled = sequence + 1, [], 0
                if len(out) >= 2048:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)
        out, room, used = [], 0, 0
        while open_:  # the rest, in powers of two
            if used == room:
                room, used = 1 << (filled.bit_length() - 1), 0
                filled -= room
                sequence += 1
            i, start, n, x, total, _ = open_.pop(0)
            n_now = min(n, room - used)
            out.append(_piece((i, start, n_now, x[:n_now], total, used), sequence, with_ids))
            used += n_now
            if n > n_now:
                open_.insert(0, (i, start + n_now, n - n_now, x[n_now:], total, 0))
        yield rows(out)

    return run


def _piece(p: tuple, sequence: int, with_ids: bool) -> tuple:
    i, start, n, x, total, offset = p
    raw = x.tobytes()
    return (i, start, n, zlib.crc32(raw), total, sequence, offset, raw if with_ids else None)


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document; with_ids adds the piece's ids, four bytes each.

    The encoded documents are written out, so that neither the sampling of ranges nor a lost executor
    has them encoded again.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("the size of a sequence is a power of two")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = written(texts.mapInArrow(lean(_encoded(tokenizer)), "doc_id long, key long, width int, ids binary"), "ids")
    # Equal rows are told apart by their place in the written table.
    salted = ids.withColumn("place", F.array("key", F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64(F.monotonically_increasing_id())))
    bounds = _bounds(salted)
    along = salted.withColumn("part", placed(bounds, F.col("place"))).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("key", "doc_id", "ids")
    return along.select("doc_id", "key", "width", "ids").mapInArrow(lean(_laid_out(size, with_ids)), PIECES)


def _bounds(rows: DataFrame) -> list[list[int]]:
    """Places that cut the rows into ranges of about equal bytes."""
    spark, n = rows.sparkSession, F.length("ids") + 16
    total = rows.agg(F.sum(n)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES)
    if not total or ranges < 2:
        return []
    step = total / min(SAMPLE, ranges * PER_RANGE)  # bytes that a sampled row stands for, or its own if it has more
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("range"), "place"), 11) / float(1 << 53)
    found = sorted((list(r.place), max(step, r.n)) for r in rows.where(chance < n / step).select("place", n.alias("n")).collect())
    bounds, done, due = [], 0.0, sum(w for _, w in found) / ranges
    for place, weight in found:
        if done >= due * (len(bounds) + 1) and len(bounds) < ranges - 1:
            bounds.append(place)
        done += weight
    return bounds


def placed(bounds: list[list[int]], x: Column) -> Column:
    """How many bounds are at or below x: a binary search, a step for each bit of their number."""
    if not bounds:
        return F.lit(0)
    cuts = F.from_json(F.lit(json.dumps(bounds)), "array<array<bigint>>")  # folded into one literal
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, n: F.when(F.coalesce(F.get(cuts, at + n - 1) <= x, F.lit(False)), at + n).otherwise(at))
