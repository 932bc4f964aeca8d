"""Layered detectors of personal identifiers, each a column of spans, and the scanner that joins them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans as S

# Formats of identifiers, check-letter tables, months, scores. What stands before a match is
# looked at late, where the characters already fit, as looking behind at every position costs far more.
NRIC = r"[STFGM]\d{7}[A-Z](?<=\b[A-Z]\d{7}[A-Z])\b"
NRIC_WEIGHTS = (2, 7, 6, 5, 4, 3, 2)
NRIC_LETTERS_ST, NRIC_LETTERS_FG = "JZIHGFEDCBA", "XWUTRQPNMLK"
EMAIL = r"\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"[+3689](?<![0-9A-Za-z].)(?:(?<=\+)65[\s-]?[3689]|(?<=6)5[\s-]?[3689]|(?<!\+))\d{3}[\s-]?\d{4}(?![0-9A-Za-z])"
TEMP_IC = r"(?i)[XY](?<![0-9A-Za-z].)(?:\d{7}|\d{10})[A-Z](?![0-9A-Za-z])"
CASE_NUMBER = r"\d(?<![0-9A-Za-z].)\d{9}[A-Za-z](?![0-9A-Za-z])"
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t)?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATE_ISO = r"\d(?<![0-9A-Za-z].)\d{3}-(\d{2})-(\d{2})(?:[ T]\d{2}:\d{2}(?::\d{2})?)?(?![0-9A-Za-z])"
DATE_NUMERIC = r"\d(?<![0-9A-Za-z].)\d{0,3}([/.\-])\d{1,2}\1\d{1,4}(?![0-9A-Za-z])"
DATE_DAY_NAME = rf"(?i)(\d(?<![0-9A-Za-z].)\d?)(?:st|nd|rd|th)?[ \-](?:{MONTHS})[ ,\-]+\d{{2,4}}(?![0-9A-Za-z])"
DATE_NAME_DAY = rf"(?i)(?=[ADFJMNOS])(?<![A-Za-z])(?:{MONTHS})\.?[ \-](\d{{1,2}})(?:st|nd|rd|th)?[ ,\-]+\d{{2,4}}(?![0-9A-Za-z])"
DATE_BARE_14, DATE_BARE_8 = r"\d(?<![0-9A-Za-z].)\d{13}(?![0-9A-Za-z])", r"\d(?<![0-9A-Za-z].)\d{7}(?![0-9A-Za-z])"
#: What every text with a match of a pattern has, asked before the pattern itself: best what begins with a rare character.
HINTS = {
    EMAIL: "@", PHONE: r"[3689]\d{3}[\s-]?\d{4}", TEMP_IC: r"[XYxy]\d{7}", CASE_NUMBER: r"\d{10}[A-Za-z]", DATE_ISO: r"-\d{2}-\d{2}", DATE_NUMERIC: r"[/.\-]\d{1,2}[/.\-]\d",
    DATE_DAY_NAME: r"[ \-][ADFJMNOSadfjmnos][A-Za-z]{2,8}[ ,\-]+\d{2}", DATE_NAME_DAY: r"[A-Za-z.][ \-]\d{1,2}(?:[SsNnRrTt][TtDdHh])?[ ,\-]+\d{2}", DATE_BARE_14: r"\d{14}", DATE_BARE_8: r"\d{8}",
}
SCORES = {"nric": 1.0, "nric_shape": 0.5, "email": 1.0, "phone": 0.9, "temp_ic": 0.7, "case_number": 0.7, "iso": 0.85, "numeric": 0.8, "named": 0.9, "bare": 0.6}
#: Names that a plan may hold.
MOST_NAMES = 5000
#: Every built-in format has one of these characters, dates among them.
ANY_FORMAT = "[0-9@]"
#: Layers whose findings count at the lower bar.
CONFIDENT_SOURCES = ("header", "gazetteer", "sg", "custom_regex")


def nric_letter(prefix: Column, digits: Column) -> Column:
    """The check letter of a number with prefix S, T, F or G; null for others."""
    terms = [F.coalesce(F.substring(digits, k, 1).try_cast("int"), F.lit(0)) * w for k, w in enumerate(NRIC_WEIGHTS, 1)]
    sums = reduce(lambda a, x: a + x, terms)
    r = (sums + F.when(prefix.isin("T", "G"), 4).otherwise(0)) % 11 + 1
    return F.when(prefix.isin("S", "T"), F.substring(F.lit(NRIC_LETTERS_ST), r, 1)).when(prefix.isin("F", "G"), F.substring(F.lit(NRIC_LETTERS_FG), r, 1))


def nric_score(value: Column) -> Column:
    """1 for a number of the right shape and check letter, 0.5 for the shape alone."""
    fits = nric_letter(F.substring(value, 1, 1), F.substring(value, 2, 7)) == F.substring(value, 9, 1)
    return F.when(fits, SCORES["nric"]).otherwise(SCORES["nric_shape"])


def nric(text: Column) -> Column:
    return S.find(text, NRIC, lambda a, b, m: S.span(a, b, "nric_fin", m, "sg", nric_score(m)))


def _plain(pattern: str, category: str):
    return lambda text: S.find(text, pattern, lambda a, b, m: S.span(a, b, category, m, "sg", SCORES[category]), hint=HINTS.get(pattern))


email, phone, temp_ic, case_number = _plain(EMAIL, "email"), _plain(PHONE, "phone"), _plain(TEMP_IC, "temp_ic"), _plain(CASE_NUMBER, "case_number")


def day_month(a: Column, b: Column) -> Column:
    """Whether two numbers are a day and a month in either order."""
    return (a.between(1, 31) & b.between(1, 12)) | (b.between(1, 31) & a.between(1, 12))


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _iso_fits(m: Column) -> Column:
    part = lambda at: F.substring(m, at, 2).cast("int")
    return part(6).between(1, 12) & part(9).between(1, 31)


def _numeric_fits(m: Column) -> Column:
    """The match is three numbers and twice the same separator."""

    def fits(p: Column) -> Column:
        first, last = p[0], p[2]
        a, b, c = (p[k].cast("int") for k in range(3))
        year_first = (F.length(first) == 4) & (F.length(last) <= 2)
        return F.when(year_first, b.between(1, 12) & c.between(1, 31)).otherwise(F.length(last).isin(2, 4) & (F.length(first) <= 2) & day_month(a, b))

    return S.let(F.split(m, r"[/.\-]"), fits)


def _bare_fits(m: Column) -> Column:
    part = lambda at, n: F.substring(m, at, n).cast("int")
    year_first = part(1, 4).between(1900, 2099) & part(5, 2).between(1, 12) & part(7, 2).between(1, 31)
    return year_first | (part(5, 4).between(1900, 2099) & day_month(part(1, 2), part(3, 2)))


def dates(text: Column, include_bare: bool = False) -> Column:
    """Dates in order of precedence: a later form that overlaps an accepted date is dropped."""
    day = lambda pattern: lambda m: _int(m, pattern, 1).between(1, 31)
    forms = [(DATE_ISO, "iso", _iso_fits), (DATE_NUMERIC, "numeric", _numeric_fits), (DATE_DAY_NAME, "named", day(DATE_DAY_NAME)), (DATE_NAME_DAY, "named", day(DATE_NAME_DAY))]
    if include_bare:
        forms += [(DATE_BARE_14, "bare", _bare_fits), (DATE_BARE_8, "bare", _bare_fits)]
    found = [S.find(text, p, lambda a, b, m, k=k: S.span(a, b, "date", m, "date", SCORES[k]), v, HINTS[p]) for p, k, v in forms]
    return S.let(F.concat(*found), lambda all_: F.when(F.size(all_) <= 1, all_).otherwise(S.without_overlaps(all_)))


def _quoted(value: Column) -> Column:
    """A pattern for the value as a whole phrase, in any case."""
    return F.concat(F.lit(r"(?iu)\b\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))


def _phrases(text: Column, values: Column, category, source: str) -> Column:
    ordered = F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    held = F.filter(ordered, lambda v: F.contains(F.lower(text), F.lower(v)))
    return F.flatten(F.transform(held, lambda v: S.find(text, _quoted(v), lambda a, b, m: S.span(a, b, category(v), m, source, 1.0))))


def header(text: Column, known: Column) -> Column:
    """Known values of the record, wherever they stand: `id` where digits follow at most letters, else `name`."""
    kind = lambda v: F.when(v.rlike(r"^(?:\d+|[A-Za-z]*\d+\w*)$"), "id").otherwise("name")
    return F.when(known.isNull() | text.isNull(), S.no_spans()).otherwise(_phrases(text, known, kind, "header"))


def gazetteer(text: Column, names: list[str] | Column) -> Column:
    """Whole phrases of a short list of names, which the plan holds; see operators.gazetteer for others."""
    if not isinstance(names, Column) and len(names) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} names: use operators.gazetteer")
    values = names if isinstance(names, Column) else F.array(*map(F.lit, names)).cast("array<string>")
    return F.when(text.isNull(), S.no_spans()).otherwise(_phrases(text, values, lambda _v: F.lit("name"), "gazetteer"))


@dataclass(frozen=True)
class CustomRule:
    pattern: str
    category: str = "custom"
    score: float = 1.0


def compiled_rules(specs: list[dict], spark=None) -> tuple[list[CustomRule], list[str]]:
    """The rules whose patterns Python and, given a session, Java accept; a note for each of the others."""
    kept, notes = [], []
    for spec in specs or []:
        try:
            re.compile(spec["pattern"])
            if spark is not None:
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(spec["pattern"])
            kept.append(CustomRule(spec["pattern"], spec.get("category", "custom"), float(spec.get("score", 1.0))))
        except Exception as e:  # noqa: BLE001 - any fault of one rule is that rule's note
            notes.append(f"custom regex skipped ({spec!r}): {str(e).splitlines()[0]}")
    return kept, notes


def custom(text: Column, rules: list[CustomRule]) -> Column:
    found = [S.find(text, r.pattern, lambda a, b, m, r=r: S.span(a, b, r.category, m, "custom_regex", r.score)) for r in rules]
    return F.concat(*found) if found else S.no_spans()


@dataclass(frozen=True)
class Scanner:
    """What is looked for, in this order; `extra` are plug-ins, functions of a text column to spans."""

    gazetteer: tuple[str, ...] = ()
    custom: tuple[CustomRule, ...] = ()
    detect_dates: bool = True
    include_bare: bool = False
    extra: tuple = field(default=())

    def with_(self, **changes) -> Scanner:
        return replace(self, **changes)

    def formats(self, text: Column) -> Column:
        """Spans of the built-in formats."""
        found = [f(text) for f in (nric, temp_ic, case_number, email, phone)]
        if self.detect_dates:
            found.append(dates(text, self.include_bare))
        return F.when(text.rlike(ANY_FORMAT), F.concat(*found)).otherwise(S.no_spans())

    def raw(self, text: Column, known: Column | None = None, formats: Column | None = None) -> Column:
        """All layers' spans, overlaps and all. formats may have those of the built-in formats where they are known."""
        layers = []
        if known is not None:
            layers.append(header(text, known))
        if self.gazetteer:
            layers.append(gazetteer(text, list(self.gazetteer)))
        layers.append(self.formats(text) if formats is None else F.coalesce(formats, self.formats(text)))
        if self.custom:
            layers.append(custom(text, list(self.custom)))
        layers += [f(text) for f in self.extra]
        return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, S.no_spans()).otherwise(F.concat(*layers))

    def scan(self, text: Column, known: Column | None = None) -> Column:
        return S.merge(self.raw(text, known))


def raw(df, text: str, scanner: Scanner | None = None, known: str | None = None, out: str = "raw", more: Column | None = None):
    """df with a column of all layers' spans, and those of `more` after them.

    The built-in formats of ASCII texts are found in Arrow batches (see formats), those of others by columns."""
    from . import formats

    scanner = scanner or Scanner()
    rows = df.withColumn("__formats", formats.found(F.col(text), scanner.detect_dates, scanner.include_bare))
    spans = scanner.raw(F.col(text), F.col(known) if known else None, F.col("__formats"))
    return S.once(rows, out, spans if more is None else F.concat(spans, more)).drop("__formats")


def scanned(df, text: str, scanner: Scanner | None = None, known: str | None = None, out: str = "spans"):
    """df with a column of merged spans."""
    return S.once(raw(df, text, scanner, known, "__found"), out, S.merge(F.col("__found"))).drop("__found")


def redacted(df, text: str, scanner: Scanner | None = None, known: str | None = None, replacement="[REDACTED]", out: str = "redacted"):
    """df with spans and the text rewritten."""
    done = scanned(df, text, scanner, known, "spans")
    return S.once(done, out, S.rewrite(F.col(text), F.col("spans"), replacement))
