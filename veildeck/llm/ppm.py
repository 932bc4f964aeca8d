"""Language-model scores: prediction by partial matching over bytes, and a unigram base score.

Contexts of up to `order` bytes are used. Those of orders 0, 1 and 2 have at most 256^3 counts whatever the
corpus and are sent to every executor. Longer ones grow with the corpus and are never in one place: a chunk
of texts sends each of its distinct codes (a byte and its context) once, with its training count, to the
bucket of the code's three nearest bytes, which so holds all counts of all contexts that end in them, works
out the probabilities and sends them back to the chunk in the order of its codes.

A text's probability is
the product over its bytes and one end mark. A byte seen after its longest context takes
count / (total + kinds); else the escape, kinds / (total + kinds), is paid and the next shorter context
predicts, without the bytes that the longer one would have predicted (symbol exclusion); below order 0
the bytes never seen share what is left. Where nothing is left to escape to, nothing is paid, so that
each context's probabilities sum to 1.

The base score needs counts of all words of the corpus, which have no bound. Texts are read in chunks;
a chunk sends each of its distinct words once, with its number in the chunk, to be joined with the word's
count. The end mark, which all texts have, is only counted. Both sums are taken where a chunk's texts, its
words' counts and its codes' probabilities meet.

Cases: a null or empty text has one token, the end; with no training text N and V are 0; rows may repeat
and keep their own scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, drop, drop_part, lean, ready, release, written

#: Never part of UTF-8, so it stands for the ends of a text.
END = 0xFF
#: A chunk of texts is closed at either bound, or after one text beyond it.
CHUNK_BYTES, CHUNK_DOCS = 8 << 20, 40_000
#: Bytes whose codes are held at once, or one text's; distinct codes held before they are merged.
SLICE, HELD_CODES = 1 << 20, 1 << 20
FOLDS, HELD = 5, 1
#: Orders up to this are sent to every executor; buckets that the codes of higher ones are dealt to.
LOW, BUCKETS = 2, 1 << 11


def held_out(doc_id: int | None, folds: int = FOLDS, fold: int = HELD) -> bool:
    """crc32 of the id as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and end mark with the two bytes before it as one number, and where each text's begin."""
    x = np.frombuffer(b"\xff\xff" + b"\xff\xff\xff".join(texts) + b"\xff", np.uint8).astype(np.int32)
    all_codes = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    starts = np.cumsum([0, *(len(t) + 3 for t in texts)])[:-1]
    keep = np.ones(len(all_codes), bool)
    for gap in (starts[1:] - 1, starts[1:] - 2):  # the two marks before the next text
        keep[gap] = False
    return all_codes[keep], starts - 2 * np.arange(len(texts))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            ids.append(i)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= CHUNK_BYTES or len(texts) >= CHUNK_DOCS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield texts[start:]


def _summed_codes(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    if len(parts) < 2:
        return parts
    code, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return [(code, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64))]


def _count_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for ids, texts in _chunks(batches):
        for some in _slices([t for i, t in zip(ids, texts, strict=True) if not held_out(i)]):
            parts.append(np.unique(codes(some)[0], return_counts=True))
            if sum(len(c) for c, _ in parts) > HELD_CODES:
                parts = _summed_codes(parts)
    for code, n in _summed_codes(parts):
        for k in range(0, len(code), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(code[k : k + (1 << 16)].astype(np.int32)), pa.array(n[k : k + (1 << 16)])], ["code", "n"])


def log_table(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of the probability of a byte after two bytes, for every code."""
    order2 = np.zeros((1 << 16, 256), np.float32)
    order2.reshape(-1)[code] = n
    order1 = np.zeros((256, 256))
    np.add.at(order1, (code >> 8 & 0xFF, code & 0xFF), n)
    order0 = order1.sum(axis=0)

    def level(counts: np.ndarray, gone: np.ndarray, below: np.ndarray) -> np.ndarray:
        """counts without the symbols gone, which below has no part in either; rows are contexts."""
        left = np.where(gone, 0, counts)
        total, kinds = left.sum(axis=-1, keepdims=True), (left > 0).sum(axis=-1, keepdims=True)
        open_ = (below.sum(axis=-1, keepdims=True) > 0) & ~gone.all(axis=-1, keepdims=True)
        escape = np.where(total > 0, np.where(open_, kinds / np.maximum(total + kinds, 1), 0), 1.0)
        own = np.where(total > 0, left / np.maximum(np.where(open_, total + kinds, total), 1), 0)
        return own + escape * below

    def chain(gone: np.ndarray, shorter: tuple[np.ndarray, ...]) -> np.ndarray:
        """The distribution without the symbols gone, by the contexts in shorter, longest first."""
        if not shorter:
            rest = (~gone).sum(axis=-1, keepdims=True)
            return np.where(gone, 0, 1 / np.maximum(rest, 1))
        counts = np.broadcast_to(shorter[0], gone.shape)
        return level(counts, gone, chain(gone | (counts > 0), shorter[1:]))

    out = np.empty((1 << 16, 256), np.float32)
    none = np.zeros((1, 256), bool)
    have = order2.any(axis=1)
    for b in range(256):
        known = order1[b : b + 1]
        plain = np.log10(chain(none, (known, order0)))
        out[b::256] = plain  # contexts that end in b
        rows = np.flatnonzero(have[b::256]) * 256 + b
        if len(rows):
            own = order2[rows].astype(np.float64)
            out[rows] = np.log10(chain(np.zeros(own.shape, bool), (own, known, order0)))
    return out.reshape(-1)


def trained(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all training texts: at most 256^3 of them."""
    got = docs.mapInArrow(lean(_count_codes), "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return got["code"].to_numpy().astype(np.int64), got["n"].to_numpy()


def long_codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and end mark with its context as one number, nearest context byte first and the byte itself
    last, so that in sorted order all contexts stand together that end alike; and where each text's begin."""
    mark = b"\xff" * order
    x = np.frombuffer(mark + (b"\xff" + mark).join(texts) + b"\xff", np.uint8).astype(np.int64)
    n = len(x) - order
    found = x[order:].copy()
    for k in range(1, order + 1):
        found |= x[order - k : order - k + n] << (8 * (order + 1 - k))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    keep = np.ones(n, bool)
    ends = np.cumsum(sizes + order)[:-1]
    for k in range(order):  # the marks before the next text
        keep[ends - 1 - k] = False
    return found[keep], np.cumsum(sizes) - sizes


def _bucket(code: np.ndarray, order: int) -> np.ndarray:
    near = (code >> (8 * (order + 1 - min(order, LOW + 1)))).astype(np.uint64)
    return ((near * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(21)).astype(np.int32)


def _squeezed(code: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending codes and their counts, as planes of bytes of their differences."""
    both = np.stack([np.diff(code, prepend=0), n.astype(np.int64)])
    return zlib.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsqueezed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(planes.T).view(np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in ascending keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_probabilities(code: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 of the probability of each of the ascending codes; n are their training counts, 0 for codes that
    held-out texts alone have. All trained codes with the same nearest three bytes must be among them; low has
    those of order 2. What follows a context also follows its shorter ones, so the symbols to exclude at a
    level are those of the next longer context."""
    trained_, counts = code[n > 0], n[n > 0].astype(np.float64)
    short = (low[0] >> 8 & 0xFF) << 16 | (low[0] >> 16) << 8 | low[0] & 0xFF
    levels: list[tuple] = []  # pairs of context and symbol, their counts; contexts, their totals, kinds, and excluded counts below
    for j in range(order + 1):
        if j > LOW:
            pair, weight = trained_ >> (8 * (order + 1 - j)) << 8 | trained_ & 0xFF, counts
        else:
            pair, weight = short >> (8 * (LOW + 1 - j)) << 8 | short & 0xFF, low[1]
        pair, place = np.unique(pair, return_inverse=True)
        c = np.bincount(place, weights=weight, minlength=len(pair))
        context, at = np.unique(pair >> 8, return_inverse=True)
        gone = np.zeros(len(context))
        if j:
            shorter = levels[-1]
            gone = np.bincount(at, weights=shorter[1][_found(shorter[0], pair >> 16 << 8 | pair & 0xFF)[0]], minlength=len(context))
        levels.append((pair, c, context, np.bincount(at, weights=c, minlength=len(context)), np.bincount(at, minlength=len(context)), gone))
    out, done = np.zeros(len(code)), np.zeros(len(code), bool)
    gone, gone_kinds = np.zeros(len(code)), np.zeros(len(code))
    for j in range(order, -1, -1):
        pair, c, context, total, kinds, below = levels[j]
        at, there = _found(context, code >> (8 * (order + 1 - j)))
        if not len(context):
            continue
        left, new = total[at] - gone, kinds[at] - gone_kinds
        escape = np.where(kinds[at] < 256, new, 0)
        place, seen = _found(pair, code >> (8 * (order + 1 - j)) << 8 | code & 0xFF)
        act = there & (left > 0) & ~done
        out[act] += np.log10(np.where(seen, c[place], escape)[act] / (left + escape)[act])
        done |= act & seen
        gone, gone_kinds = np.where(there, below[at], gone), np.where(there, kinds[at], gone_kinds)
    out[~done] -= np.log10(256 - len(levels[0][0])) if not done.all() else 0
    return out


def _distinct(texts: list[bytes], train: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of a chunk, ascending, and their counts in training texts."""
    parts = []
    for kind in (True, False):
        for some in _slices([t for t, k in zip(texts, train, strict=True) if k == kind]):
            code, n = np.unique(long_codes(some, order)[0], return_counts=True)
            parts.append((code, n if kind else np.zeros(len(n), np.int64)))
    return _summed_codes(parts)[0]


#: A chunk's rows by kind: its distinct words, its distinct codes by bucket, its texts.
WORDS, CODES, TEXTS = range(3)
FIELDS = "kind int, chunk long, token binary, number int, n_train long, masked binary, ids binary, bucket int, data binary"


def _postings(order: int):
    """Per chunk: its distinct words and the end mark, its distinct codes by bucket, and one row of its texts
    and their ids."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in FIELDS.split(", ")])

    def rows(n: int, kind: int, chunk: int, **columns) -> pa.RecordBatch:
        columns |= {"kind": np.full(n, kind, np.int32), "chunk": np.full(n, chunk)}
        return pa.RecordBatch.from_arrays([pa.array(columns[x], schema.field(x).type) if x in columns else pa.nulls(n, schema.field(x).type) for x in schema.names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            chunk = int(np.random.default_rng().integers(1 << 62))  # a name only: results don't depend on it
            train = [not held_out(i) for i in ids]
            index: dict[bytes, int] = {}
            n_train = Counter()
            for t, known in zip(texts, train, strict=True):
                own = [index.setdefault(x, len(index)) for x in t.lower().split()]
                if known:
                    n_train.update(own)
            words, n = list(index), np.fromiter((n_train[k] for k in range(len(index))), np.int64, len(index))
            for k in range(0, len(words), 1 << 16):
                m = len(words[k : k + (1 << 16)])
                yield rows(m, WORDS, chunk, token=words[k : k + m], number=np.arange(k, k + m, dtype=np.int32), n_train=n[k : k + m])
            yield rows(1, WORDS, chunk, token=[b""], n_train=[sum(train)])
            del index, n_train, words, n
            code, count = _distinct(texts, train, order)
            bucket = _bucket(code, order)
            by = np.argsort(bucket, kind="stable")
            code, count, bucket = code[by], count[by], bucket[by]
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            data = [_squeezed(code[i:j], count[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
            yield rows(len(data), CODES, chunk, bucket=bucket[edges[:-1]], data=data)
            masked = np.array([i is None for i in ids])
            plain = np.array([0 if i is None else i for i in ids], np.int64)
            raw = b"".join(texts)
            sizes = np.array([len(raw), *map(len, texts)], np.int64)
            data = np.int64(len(texts)).tobytes() + sizes.tobytes() + pa.compress(raw, "zstd", asbytes=True)
            yield rows(1, TEXTS, chunk, masked=[masked.tobytes()], ids=[plain.tobytes()], data=[data])

    return run


def _texts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n + 1, 8)
    raw = pa.decompress(data[8 * (n + 2) :], decompressed_size=int(sizes[0]), codec="zstd", asbytes=True) if sizes[0] else b""
    ends = np.cumsum(sizes[1:])
    return [raw[a:b] for a, b in zip((ends - sizes[1:]).tolist(), ends.tolist(), strict=True)]


def _judged(model, order: int):
    """The probabilities of a bucket's codes, for each chunk in the order of its own codes."""

    def run(rows: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for data in rows["data"]:
            parts.append(_unsqueezed(data.as_py()))
            if sum(len(c) for c, _ in parts) > HELD_CODES:
                parts = _summed_codes(parts)
        code, n = _summed_codes(parts)[0]
        logs = log_probabilities(code, n, model.value, order).astype(np.float32)
        found = [logs[np.searchsorted(code, _unsqueezed(data.as_py())[0])].tobytes() for data in rows["data"]]
        return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "data": pa.array(found, pa.binary())})

    return run


def _coded(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice of texts its distinct codes, the number of each byte's code among them, and where texts begin."""
    out = []
    for some in _slices(texts):
        own, starts = long_codes(some, order)
        coded = pa.array(own).dictionary_encode()
        out.append((coded.dictionary.to_numpy(), coded.indices.to_numpy(), starts))
    return out


def _summed(n_all: int, kinds: int, ends: int, order: int):
    """The texts of one chunk with their scores."""
    rest = n_all + 0.5 * (kinds + 1)

    def run(words: pa.Table, rows: pa.Table) -> pa.Table:
        (at,) = np.flatnonzero(rows["ids"].is_valid().to_numpy())  # a chunk has one row of its texts
        at = int(at)
        ids, masked = np.frombuffer(rows["ids"][at].as_py(), np.int64), np.frombuffer(rows["masked"][at].as_py(), bool)
        texts = _texts(rows["data"][at].as_py())
        index: dict[bytes, int] = {}
        found, lengths = [], []
        for t in texts:
            w = t.lower().split()
            lengths.append(len(w) + 1)
            found.append(np.fromiter((index.setdefault(x, len(index)) for x in w), np.int32, len(w)))
        tokens, doc = np.concatenate(found), np.repeat(np.arange(len(texts)), np.array(lengths) - 1)
        counts = np.zeros(len(index))
        counts[words["number"].to_numpy()] = words["c"].to_numpy()
        base = np.log10((ends + 0.5) / rest) + np.bincount(doc, weights=np.log10((counts + 0.5) / rest)[tokens], minlength=len(texts))
        known = int(ends > 0) + np.bincount(doc, weights=counts[tokens] > 0, minlength=len(texts)).astype(np.int64)
        del index, found, tokens, doc, counts  # the words' share, before that of the codes is made
        coded = _coded(texts, order)
        code = np.unique(np.concatenate([c for c, _, _ in coded]))
        logs = np.empty(len(code))
        bucket = rows["bucket"].fill_null(-1).to_numpy()
        by_bucket = [np.frombuffer(rows["data"][int(k)].as_py(), np.float32) for k in np.argsort(bucket) if bucket[k] >= 0]
        logs[np.argsort(_bucket(code, order), kind="stable")] = np.concatenate(by_bucket)
        scores = np.concatenate([np.add.reduceat(logs[np.searchsorted(code, c)][place], starts) for c, place, starts in coded])
        del texts, coded, code, logs, by_bucket
        release()
        return pa.table({"doc_id": pa.array(ids, mask=masked), "held_out": [held_out(None if m else int(i)) for i, m in zip(ids, masked, strict=True)], "n_tokens": np.array(lengths, np.int64), "n_known": known, "train_tokens": np.full(len(ids), n_all, np.int64), "base_score": base, "score": scores})

    return run


def scored(docs: DataFrame, order: int = LOW) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; contexts of up
    to `order` bytes, 2 to 6."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ready(spark)
    model = spark.sparkContext.broadcast(trained(texts))
    found, path = dealt(texts.mapInArrow(lean(_postings(order)), FIELDS), "postings", "kind")
    words = found.where(F.col("kind") == WORDS)
    counts = written(words.groupBy("token").agg(F.sum("n_train").alias("c")).where("c > 0"), "counts")
    n_all, kinds, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("token") == 0, F.col("c"))), F.lit(0))).first()
    # The end mark, which every chunk has, stays out of the join.
    back = written(words.where("number is not null").select("chunk", "number", "token").join(counts, "token").select("chunk", "number", "c"), "back")
    drop_part(spark, path, "kind", WORDS)
    drop(counts)
    ready(spark)
    rows = found.select("kind", "chunk", "bucket", "ids", "masked", "data")
    judged = written(rows.where(F.col("kind") == CODES).select("chunk", "bucket", "data").groupBy("bucket").applyInArrow(_judged(model, order), "chunk long, bucket int, data binary"), "logs")
    drop_part(spark, path, "kind", CODES)
    ready(spark)
    both = judged.unionByName(rows.where(F.col("kind") == TEXTS).drop("kind"), allowMissingColumns=True)
    return back.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_summed(n_all, kinds, ends, order), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
