"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the `TOP` most frequent letter n-grams (one to three letters, a word's edges marked by a
space) of a language, or of a document, in order of frequency. A language's out-of-place distance is the
sum over the document's n-grams of the difference between their ranks here and there, `TOP` for one that
the language's profile lacks; the nearest language wins. The score is 1 - distance / largest distance.

Profiles are fitted on a sample of labelled rows: about `SAMPLE` documents a language, chosen by a hash of
their id and text, of the `LANGUAGES` labels that most rows have. Every document is judged by its whole text.

Cases: a null text, or one without a letter, is `und` with score 0, as is all text where no language was
learned; rows may repeat, ids may be null; ties go to the language that sorts first; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean

TOP = 300
ORDERS = 3
#: Documents a language that profiles are fitted on, about.
SAMPLE = 2000
#: Labels that are learned: those of most rows, ties by name.
LANGUAGES = 500
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
FOLDS, HELD = 4, 2


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as numbers in ascending order, and their counts."""
    found = LETTERS.findall(text.lower())
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.frombuffer(f" {' '.join(found)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    gap = x == 32
    pairs = x[:-1] << 21 | x[1:]
    parts = [x[~gap], pairs]  # a pair is larger than any single letter, three letters than any pair
    if ORDERS > 2:
        parts.append((pairs[:-1] << 21 | x[2:])[~gap[1:-1]])
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by number."""
    return codes[np.argsort(-counts, kind="stable")[:top]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def emit(lang: str) -> pa.RecordBatch:
        codes, place = np.unique(np.concatenate([c for c, _ in held[lang]]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([k for _, k in held[lang]])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = grams(text)
            held.setdefault(lang, []).append(got)
            size += len(got[0])
            if size > 1 << 21:
                for x in held:
                    yield emit(x)
                held, size = {}, 0
    for x in held:
        yield emit(x)


def profiles(labelled: DataFrame, sample: int = SAMPLE, top: int = TOP) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language of the rows doc_id, text, lang: at most `top` each."""
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), "lang").where("lang is not null and text is not null")
    # A row for each language, as the profiles themselves come back: the shares then need no join of texts.
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    place = F.shiftrightunsigned(F.xxhash64(F.lit("profile"), "doc_id", "text"), 11) / float(1 << 53)
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, sample / n))])
    chosen = rows.where(place < share[F.col("lang")]).select("lang", "text")
    sums = chosen.mapInArrow(lean(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "gram", "rank").toPandas()
    return {lang: g.sort_values("rank")["gram"].to_numpy() for lang, g in best.groupby("lang")}


class Judge:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profile: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = sorted(profile), top
        self.known = np.unique(np.concatenate([profile[x] for x in self.langs])) if profile else np.zeros(0, np.int64)
        self.rank = np.full((len(self.langs), len(self.known) + 1), -1)  # the last column: in no profile
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.known, profile[lang])] = np.arange(len(profile[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text) if text and any(map(str.isalpha, text)) else ((), ())  # not of other numerals alone
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.top)
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        there = self.rank[:, at]
        far = np.where(there < 0, self.top, np.abs(there - np.arange(len(own)))).sum(axis=1)
        k = int(far.argmin())
        return self.langs[k], 1 - float(far[k]) / (self.top * len(own))


def identified(docs: DataFrame, profile: dict[str, np.ndarray]) -> DataFrame:
    """docs with lang_pred and score; the columns of docs are kept, under whatever names."""
    judge = Judge(profile)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("judged")) if docs.columns else docs
    schema = f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["row", "lang_pred", "score"])

    return packed.mapInArrow(lean(run), schema)
