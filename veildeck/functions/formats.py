"""The built-in formats in Arrow batches: each pattern goes once over all texts of a batch.

A pattern of Java's costs microseconds for each text, however little it finds, and nine of them were nearly all of
a scan. Here texts are searched end to end, with a character between them that no format holds or looks for. That
is done for ASCII texts alone, in which both engines agree on digits, blanks, boundaries and cases; for the others
the spans are null, and the columns of `detectors` find them."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import detectors as D
from . import spans as S

SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("text", pa.string()), ("source", pa.string()), ("score", pa.float64())])
BETWEEN = "\0"


def _nric_scores(text: str, start: np.ndarray) -> np.ndarray:
    """As detectors.nric_score, of the numbers that begin at these places."""
    codes = np.frombuffer(text.encode("ascii"), np.uint8)[start[:, None] + np.arange(9)].astype(np.int64)
    first = codes[:, 0]
    total = (codes[:, 1:8] - ord("0")) @ np.array(D.NRIC_WEIGHTS) + 4 * np.isin(first, [ord(x) for x in "TG"])
    letters = [np.frombuffer(x.encode("ascii"), np.uint8)[total % 11] for x in (D.NRIC_LETTERS_ST, D.NRIC_LETTERS_FG)]
    fits = np.where(np.isin(first, [ord(x) for x in "ST"]), letters[0] == codes[:, 8], np.isin(first, [ord(x) for x in "FG"]) & (letters[1] == codes[:, 8]))
    return np.where(fits, D.SCORES["nric"], D.SCORES["nric_shape"])


def _day_month(a: int, b: int) -> bool:
    return 1 <= a <= 31 and 1 <= b <= 12 or 1 <= b <= 31 and 1 <= a <= 12


def _day(m: re.Match) -> bool:
    return 1 <= int(m[1]) <= 31


def _iso_fits(m: re.Match) -> bool:
    return 1 <= int(m[1]) <= 12 and 1 <= int(m[2]) <= 31


def _numeric_fits(m: re.Match) -> bool:
    first, middle, last = m[0].split(m[1])
    if len(first) == 4 and len(last) <= 2:
        return 1 <= int(middle) <= 12 and 1 <= int(last) <= 31
    return len(last) in (2, 4) and len(first) <= 2 and _day_month(int(first), int(middle))


def _bare_fits(m: re.Match) -> bool:
    part = lambda at, n: int(m[0][at : at + n])
    return 1900 <= part(0, 4) <= 2099 and 1 <= part(4, 2) <= 12 and 1 <= part(6, 2) <= 31 or 1900 <= part(4, 4) <= 2099 and _day_month(part(0, 2), part(2, 2))


def _matches(pattern: str, text: str, begins: np.ndarray, ends: np.ndarray):
    """Matches in the joined texts, in order. Patterns that ignore case step over every character; they are tried
    only in texts that have what each match has."""
    find = re.compile(pattern, re.ASCII).finditer
    if not pattern.startswith("(?i)"):
        yield from find(text)
        return
    at = np.fromiter((m.start() for m in re.finditer(D.HINTS[pattern], text, re.ASCII)), np.int64)
    for k in np.unique(np.searchsorted(begins, at, "right") - 1):
        yield from find(text, int(begins[k]), int(ends[k]))


def _outside(start: np.ndarray, end: np.ndarray, taken: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which spans overlap none of those taken, which are apart from each other and in order."""
    if not len(taken[0]):
        return np.ones(len(start), bool)
    k = np.searchsorted(taken[1], start, "right")
    return (k == len(taken[0])) | (taken[0][np.minimum(k, len(taken[0]) - 1)] >= end)


def batch(texts: pa.Array, detect_dates: bool = True, include_bare: bool = False) -> pa.Array:
    """Spans of each text as Scanner.formats gives them, in its order; null where a text is null or is left to it."""
    use = pc.fill_null(pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, BETWEEN))), False)
    rows = np.flatnonzero(use.to_numpy(zero_copy_only=False))
    kept = texts.filter(use).to_pylist()
    joined = BETWEEN.join(kept)
    sizes = np.fromiter(map(len, kept), np.int64, len(kept))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray, str, str]] = []

    def search(pattern: str, fits: Callable[[re.Match], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
        found = [m.span() for m in _matches(pattern, joined, begins, ends) if fits is None or fits(m)]
        both = np.array(found, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    for pattern, category in ((D.NRIC, "nric_fin"), (D.TEMP_IC, "temp_ic"), (D.CASE_NUMBER, "case_number"), (D.EMAIL, "email"), (D.PHONE, "phone")):
        start, end = search(pattern)
        layers.append((start, end, _nric_scores(joined, start) if pattern == D.NRIC else np.full(len(start), D.SCORES[category]), category, "sg"))
    if detect_dates:
        taken = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        forms = [(D.DATE_ISO, "iso", _iso_fits), (D.DATE_NUMERIC, "numeric", _numeric_fits), (D.DATE_DAY_NAME, "named", _day), (D.DATE_NAME_DAY, "named", _day)]
        for pattern, kind, fits in forms + [(D.DATE_BARE_14, "bare", _bare_fits), (D.DATE_BARE_8, "bare", _bare_fits)] * include_bare:
            start, end = search(pattern, fits)
            free = _outside(start, end, taken)
            layers.append((start[free], end[free], np.full(int(free.sum()), D.SCORES[kind]), "date", "date"))
            taken = tuple(np.sort(np.concatenate([t, x[free]])) for t, x in zip(taken, (start, end), strict=True))
    start, end, score = (np.concatenate([x[k] for x in layers]) for k in range(3))
    layer = np.repeat(np.arange(len(layers)), [len(x[0]) for x in layers])
    text = np.searchsorted(begins, start, "right") - 1
    order = np.argsort(text, kind="stable")
    start, end, score, layer, text = (x[order] for x in (start, end, score, layer, text))
    named = lambda k: pa.array([x[k] for x in layers], pa.string()).take(pa.array(layer))
    at = begins[text] if len(text) else start
    found = pa.array([joined[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.string())
    values = pa.StructArray.from_arrays([pa.array(start - at, pa.int32()), pa.array(end - at, pa.int32()), named(3), found, named(4), pa.array(score, pa.float64())], fields=list(SPAN))
    counts = np.zeros(len(texts), np.int64)
    counts[rows] = np.bincount(text, minlength=len(rows))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values, mask=pc.invert(use))


def found(text: Column, detect_dates: bool = True, include_bare: bool = False) -> Column:
    """batch() as a column; it can't stand within a lambda function."""

    def run(texts: pa.Array) -> pa.Array:
        return batch(texts, detect_dates, include_bare)

    return F.arrow_udf(run, S.SPANS)(text)
