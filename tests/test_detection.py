"""Detectors, merging and rewriting: cases by format, and random strings against a plain twin."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veildeck.functions import detectors as D
from veildeck.functions import pseudonyms as P
from veildeck.functions import spans as S

CASES = [
    # detector, text, what is found
    ("nric", "S1234567D", ["S1234567D"]),
    ("nric", "Series AB12 protocol X7 s1234567d", []),
    ("temp_ic", "X1234567A x1234567a Y1234567890B", ["X1234567A", "x1234567a", "Y1234567890B"]),
    ("temp_ic", "Z1234567A X123456A X12345678A aX1234567A X1234567AB", []),
    ("case_number", "1234567890A", ["1234567890A"]),
    ("case_number", "1234567890 123456789A 12345678901A f1234567890A", []),
    ("phone", "+65 9123 4567, 91234567 (62345678) 6591234567", ["+65 9123 4567", "91234567", "62345678", "6591234567"]),
    ("phone", "9123456 87591237cef8c902 AB87591237 12345678", []),
    ("email", "to patient@example.sg or a.b+c@x-y.co.uk.", ["patient@example.sg", "a.b+c@x-y.co.uk"]),
    ("email", "a@b nothing@ @x.com", []),
    ("dates", "2024-01-15 10:20:30 and 15/01/2024", ["2024-01-15 10:20:30", "15/01/2024"]),
    ("dates", "01 Jan 1970, 1st January 2024, Jan 1, 2024, Sept. 3 2021", ["01 Jan 1970", "1st January 2024", "Jan 1, 2024", "Sept. 3 2021"]),
    ("dates", "1-2/3 45/45/2024 2024-13-01 192.168.1.254 v1.2 32 Jan 2024", []),
    ("dates", "20240115", []),
    ("bare", "20240115 15012024 20240115101112 99999999", ["20240115101112", "20240115", "15012024"]),
]


def test_formats(spark):
    find = {"nric": D.nric, "temp_ic": D.temp_ic, "case_number": D.case_number, "phone": D.phone, "email": D.email, "dates": D.dates, "bare": lambda c: D.dates(c, include_bare=True)}
    df = spark.createDataFrame([(k, d, t) for k, (d, t, _) in enumerate(CASES)], "k int, d string, text string")
    for name, f in find.items():
        got = {r.k: r.s for r in df.where(F.col("d") == name).select("k", f(F.col("text")).alias("s")).collect()}
        for k, spans in got.items():
            _, text, want = CASES[k]
            assert [s.text for s in spans] == want, text
            assert all(text[s.start : s.end] == s.text for s in spans)


def test_check_letters(spark):
    df = spark.createDataFrame([("S1234567D", 1.0), ("S1234567A", 0.5), ("M1234567K", 0.5), ("G9876543N", None), ("T0000000G", None)], "v string, want double")
    got = df.select("v", "want", D.nric_score(F.col("v")).alias("score"), D.nric_letter(F.substring("v", 1, 1), F.substring("v", 2, 7)).alias("letter")).collect()
    weights = (2, 7, 6, 5, 4, 3, 2)
    for r in got:
        total = sum(int(d) * w for d, w in zip(r.v[1:8], weights, strict=True)) + (4 if r.v[0] in "TG" else 0)
        letter = {"S": "JZIHGFEDCBA", "T": "JZIHGFEDCBA", "F": "XWUTRQPNMLK", "G": "XWUTRQPNMLK"}.get(r.v[0])
        assert r.letter == (letter[total % 11] if letter else None)
        if r.want is not None:
            assert r.score == r.want


def plain_merge(spans):
    out = []
    for s in sorted(spans, key=lambda s: (s[0], -(s[1] - s[0]), -s[3])):
        if out and s[0] < out[-1][1] and out[-1][0] < s[1]:
            p = out[-1]
            best = p if (p[1] - p[0], p[3]) >= (s[1] - s[0], s[3]) else s
            out[-1] = (min(p[0], s[0]), max(p[1], s[1]), best[2], max(p[3], s[3]))
        else:
            out.append(s)
    return out


def test_random_strings_against_plain_search(spark):
    rng = random.Random(1)
    bits = ["S1234567D", "91234567", "ab", "1234567890A", " ", "-", "x@y.sg", "Tan", "Wei Ming", "tan wei", "+65 ", "8123 4567", ".", "é", "X1234567A", "日本", ""]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(300)]
    names = ("Tan", "Tan Wei", "Wei Ming")
    rules = [(re.compile(p), c, s) for p, c, s in [(r"\b[STFGM]\d{7}[A-Z]\b", "nric_fin", None), (D.TEMP_IC[4:], "temp_ic", 0.7), (D.CASE_NUMBER, "case_number", 0.7), (D.EMAIL, "email", 1.0), (D.PHONE, "phone", 0.9)]]
    rules[1] = (re.compile(D.TEMP_IC[4:], re.IGNORECASE), "temp_ic", 0.7)
    want = []
    for t in texts:
        clean = t.replace("", "�")
        spans = [(m.start(), m.end(), "name", 1.0) for n in sorted(names, key=len, reverse=True) for m in re.finditer(rf"\b{re.escape(n)}\b", clean, re.IGNORECASE)]
        for rx, c, s in rules:
            spans += [(m.start(), m.end(), c, s if s is not None else (1.0 if m[0] == "S1234567D" else 0.5)) for m in rx.finditer(clean)]
        want.append(plain_merge(spans))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r for r in D.redacted(df, "text", D.Scanner(gazetteer=names, detect_dates=False)).collect()}
    for k, (t, w) in enumerate(zip(texts, want, strict=True)):
        assert [(s.start, s.end, s.category, s.score) for s in got[k].spans] == w, t
        out, at = [], 0
        for a, b, *_ in w:
            out += [t[at:a], "[REDACTED]"]
            at = b
        assert got[k].redacted == "".join([*out, t[at:]])


def test_header_tokens_and_names(spark):
    rows = [("Nurul Aisyah Binte Rahman, id MRN0099887, not Tanjong", ["Aisyah", "MRN0099887", "12345", r"a\Eb.c"]), (r"x a\Eb.c y 12345", ["Aisyah", "12345", r"a\Eb.c"]), ("nothing", None), (None, ["x"]), ("", ["x"])]
    df = spark.createDataFrame(rows, "text string, known array<string>")
    got = [[(s.text, s.category, s.source) for s in r.spans] for r in D.scanned(df, "text", D.Scanner(gazetteer=("Nurul Aisyah", "Tan")), "known").collect()]
    assert got[0] == [("Nurul Aisyah", "name", "gazetteer"), ("MRN0099887", "id", "header")]
    assert sorted(got[1]) == sorted([(r"a\Eb.c", "name", "header"), ("12345", "id", "header")])
    assert got[2:] == [[], [], []]


def test_custom_rules_skip_bad_patterns(spark):
    kept, notes = D.compiled_rules([{"pattern": r"\bAB-\d+", "category": "ref"}, {"pattern": "("}, {"category": "x"}], spark)
    assert [r.category for r in kept] == ["ref"] and kept[0].score == 1.0 and len(notes) == 2
    row = D.redacted(spark.createDataFrame([("see AB-12 now",)], "text string"), "text", D.Scanner(custom=tuple(kept))).first()
    assert row.redacted == "see [REDACTED] now"


def test_replacement_by_function(spark):
    df = spark.createDataFrame([("a x@y.sg b",)], "text string")
    row = D.redacted(df, "text", replacement=lambda s: F.concat(F.lit("<"), s["category"], F.lit(">"))).first()
    assert row.redacted == "a <email> b"


def test_pseudonyms(spark):
    import hashlib

    df = spark.createDataFrame([("é Tan", b"\x00\xffsalt")], "v string, salt binary")
    r = df.select(P.salted(F.col("v"), F.col("salt")).alias("h"), P.remapped_uid(F.col("v"), F.col("salt")).alias("u"), P.date_offset(F.col("v"), F.col("salt"), 10, -10).alias("d"), P.date_offset(F.col("v"), F.col("salt"), 3, 3).alias("same")).first()
    raw = b"\x00\xffsalt"
    assert r.h == hashlib.sha256(raw + "é Tan".encode()).hexdigest()[:16]
    assert re.fullmatch(r"[0-9]+(\.(0|[1-9][0-9]*))+", r.u) and len(r.u) <= 64
    assert r.d == -10 + int.from_bytes(hashlib.sha256(raw + b"|date|" + "é Tan".encode()).digest()[:8], "big") % 21 and r.same == 3


@pytest.mark.parametrize(("value", "want"), [("20240228", "20240301"), ("20240231", "20240231"), ("2024", "2024"), ("x", "x"), (None, None)])
def test_date_shift(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(P.shifted_da(F.col("v"), F.lit(2))).first()[0] == want


def test_masks(spark):
    df = spark.createDataFrame([("",), (None,), ("ab",), ("abc",), ("Tan Wei",)], "v string")
    assert [r[0] for r in df.select(P.masked(F.col("v"))).collect()] == ["", "", "••", "a•c", "T•••••i"]


def test_merge_keeps_the_longer_label(spark):
    row = spark.range(1).select(S.merge(F.array(S.span(F.lit(5), F.lit(11), "name", F.lit("Aisyah"), "header", 1.0), S.span(F.lit(0), F.lit(11), "name", F.lit("Nurul Aisyah"), "gazetteer", 0.9))).alias("m")).first()
    assert [(s.start, s.end, s.source, s.score) for s in row.m] == [(0, 11, "gazetteer", 1.0)]
