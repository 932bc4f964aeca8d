"""Secret scans: fixed patterns, and Markov models of characters compared by likelihood.

The patterns give the base spans. Besides, runs of `RUN_LEAST` or more key characters that no base span
touches are scored by first-order Markov models: one for the random strings of each alphabet, one of ordinary
identifiers. A run is reported as `markov` if the log-likelihood ratio of the likeliest random model against
the ordinary one reaches the threshold: the whole run's, so that length counts and no kind of character is
asked for.

Both samples are labelled by how they are made, half of each trains, the other half sets the threshold.
Random strings are drawn from a seed. Ordinary identifiers are joined, as programs, paths and headings join
them, from words of about `SAMPLE_DOCS` documents, at most `SAMPLE_WORDS` of them, and from a fixed list; a
word is letters only and shorter than any secret, so no secret trains the ordinary model.

Cases: null and empty texts have no span; rows may repeat, ids may be null; equal starts go by kind; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

KINDS = ("assign", "access", "hex", "markov")
# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
NAMES = ("passw", "secret", "token", "api")

KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN_LEAST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
AGAIN = re.compile(r"(.)\1{2,}")
WORD_MOST = 12
#: Documents and words that ordinary identifiers are made from, identifiers made, random strings of each alphabet.
SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_NAMES, SAMPLE_STRINGS = 2000, 30_000, 40_000, 3000
ALPHABETS = {"base64": KEY_CHARS[:64], "base62": KEY_CHARS[:62], "url": KEY_CHARS[:62] + "_-", "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": "abcdefghijklmnopqrstuvwxyz0123456789", "letters": "abcdefghijklmnopqrstuvwxyz"}
#: Log-likelihood ratio, in nats, that is asked for at least: a secret is taken to be one run in 1.2 million.
LEAST_RATIO = 14.0
#: Share of the ordinary identifiers set aside that may reach the threshold.
FALSE_SHARE = 1e-3
KEPT_RUNS = 1 << 18
PLACEHOLDER = "<secret>"
# Words of identifiers, for corpora that have few.
PLAIN_WORDS = (
    "get set is has on to from by id key name file path data user item list map node page text line code type value index count size date time start end open close read write load save"
    " send make find next last first test main base util config option result error message request response handler manager service client server element container version number system"
).split()

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """By kind and place; ends are exclusive, in code points."""
    found: list[Span] = []
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if any(len(w) >= HEX_LEAST for w in text.split()):  # a run of hex digits is in one word
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


class Markov:
    """Counts of character pairs of a sample of strings, the first after a start mark, with a share of the
    single characters' frequencies, so that what follows a rare character isn't taken for random."""

    SHARE = 4.0

    def __init__(self, strings: list[str]):
        n = len(KEY_CHARS)
        self.index = {c: i for i, c in enumerate(KEY_CHARS)}
        counts = np.zeros((n + 1, n))
        for s in strings:
            before = n
            for c in s:
                if (k := self.index.get(c)) is None:
                    before = n
                else:
                    counts[before, k] += 1
                    before = k
        single = counts.sum(axis=0) + 0.5
        counts += self.SHARE * single / single.sum()
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True))


class Scanner:
    """The models, fitted on one half of each sample; threshold is set by the other half unless given."""

    def __init__(self, ordinary: list[str], random: dict[str, list[str]] | None = None, threshold: float | None = None):
        random = random_strings() if random is None else random
        plain = Markov(ordinary[::2]).logs
        self.ratio = np.stack([Markov(x[::2]).logs - plain for x in random.values()])
        self.index = {c: i for i, c in enumerate(KEY_CHARS)}
        self.threshold = LEAST_RATIO if threshold is None else threshold
        held = [self.llr(x) for x in ordinary[1::2] if len(x) >= RUN_LEAST]
        if threshold is None and held:
            self.threshold = max(LEAST_RATIO, float(np.quantile(held, 1 - FALSE_SHARE)))
        self.kept: dict[str, bool] = {}

    def llr(self, s: str) -> float:
        """Of the whole string, for the likeliest random model; what is repeated over twice counts twice."""
        x = [len(KEY_CHARS), *map(self.index.__getitem__, AGAIN.sub(r"\1\1", s))]
        return float(self.ratio[:, x[:-1], x[1:]].sum(axis=1).max())

    def is_random(self, s: str) -> bool:
        if (found := self.kept.get(s)) is None:
            if len(self.kept) >= KEPT_RUNS:
                self.kept.clear()
            self.kept[s] = found = self.llr(s) >= self.threshold
        return found

    def spans(self, text: str | None) -> list[Span]:
        """Base spans and those of the models, by start, then kind."""
        if not text:
            return []
        found = base_spans(text)
        if any(len(w) >= RUN_LEAST for w in text.split()):
            taken, k = _joined(found), 0
            for m in RUN.finditer(text):
                while k < len(taken) and taken[k][1] <= m.start():
                    k += 1
                if not (k < len(taken) and taken[k][0] < m.end()) and self.is_random(m[0]):
                    found.append((*m.span(), "markov"))
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def random_strings(n: int = SAMPLE_STRINGS, seed: int = 11) -> dict[str, list[str]]:
    """The labelled samples of random strings: n of each alphabet."""
    rng = np.random.default_rng(seed)
    return {name: ["".join(rng.choice(list(a), int(rng.integers(16, 48)))) for _ in range(n)] for name, a in ALPHABETS.items()}


def identifiers(words: list[str], n: int = SAMPLE_NAMES, seed: int = 23) -> list[str]:
    """The labelled sample of ordinary identifiers: n of them, from words of letters."""
    rng = random.Random(seed)
    pool, out = [*PLAIN_WORDS, *words], []
    for _ in range(n):
        own = [rng.choice(pool if rng.random() < 0.8 else PLAIN_WORDS) for _ in range(rng.randint(1, 5))]
        kind = rng.random()
        if kind < 0.03:  # a character again and again
            out.append(rng.choice(KEY_CHARS) * rng.randint(3, 40))
            continue
        if kind < 0.07:  # numbers and dates
            out.append(rng.choice(["", "-", "_", "/"]).join("".join(rng.choices("0123456789", k=rng.choice([1, 2, 2, 4, rng.randint(1, 20)]))) for _ in range(rng.randint(1, 6)))[:40])
            continue
        joint = rng.choice(["", "_", "-", "/", "camel", "upper"])
        if joint == "camel":
            name = own[0] + "".join(w[:1].upper() + w[1:] for w in own[1:])
        elif joint == "upper":
            name = "_".join(own).upper()
        else:
            name = joint.join(own)
        if rng.random() < 0.2:
            name += rng.choice(["", "-", "_"]) + str(rng.randint(0, 10 ** rng.randint(1, 4)))
        out.append(name)
    return out


def ordinary_strings(docs: DataFrame, n: int = SAMPLE_DOCS, most: int = SAMPLE_WORDS) -> list[str]:
    """Identifiers made from words of about n documents: those of the least hashes of id and text, and of their
    words at most `most`, those of the least hashes."""
    rows = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    total = rows.count()
    place = F.shiftrightunsigned(F.xxhash64(F.lit("ordinary"), "doc_id", "text"), 11) / float(1 << 53)
    words = rows.where(place < min(1.0, n / max(total, 1))).select("text").mapInArrow(lean(_words_of), "word string").distinct()
    return identifiers(sorted(r.word for r in words.orderBy(F.xxhash64("word"), "word").limit(most).collect()))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z]{{2,{WORD_MOST}}}(?![A-Za-z0-9+/_=-])")
    for b in batches:
        words: set[str] = set()
        for t in b.column(0).to_pylist():
            words.update(letters.findall(t))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["word"])


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _joined(spans: list[Span]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def redacted(text: str, spans: list[Span]) -> str:
    """Overlapping spans as one, each replaced by the placeholder."""
    out, done = [], 0
    for a, b in _joined(spans):
        out += [text[done:a], PLACEHOLDER]
        done = b
    return "".join([*out, text[done:]])


def scanned(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans and redacted_text (null text: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                spans = scanner.spans(t)
                base = [s for s in spans if s[2] != "markov"]
                for k in range(3):
                    cols[k].append(sum(s[2] == KINDS[k] for s in base))
                cols[3].append(hashlib.sha256(digest(base).encode()).hexdigest())
                cols[4].append(digest(spans))
                cols[5].append(redacted(t, spans) if spans else t)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted_text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted_text string")


def without_secrets(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """docs with the spans of text replaced, and n_chars, where it is a column, counted anew."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("scanned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redacted(t, s) if t and (s := scanner.spans(t)) else t for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "clean"])

    done = packed.mapInArrow(lean(run), f"row {packed.schema['row'].dataType.simpleString()}, clean string")
    new = {"text": F.col("clean")} | ({"n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
