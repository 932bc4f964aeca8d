"""Built-in formats: the batch search against the columns, and patterns against their plain forms."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veildeck.functions import detectors as D
from veildeck.functions import formats
from veildeck.functions import spans as S
from veildeck.plans import planted

BITS = ["S1234567D", "G9876543N", "M1234567K", "91234567", "8123 4567", "+65 ", "65-", "+", "6", "x1234567a", "Y1234567890B", "1234567890A", "2024-01-15", "T10:20:30", " 10:20", "15/01/2024", "2024.13.01", "1-2-03", "1st ", "Jan", " January, ", "Sept. 3", " May 12", "20240115101112", "15012024", "a.b+c@x-y.sg", "@", ".co", " ", "-", "_", ",", ".", "\n", "\x1c", "A", "k", "7"]
ODD = ["é", "日本", "\0", "", "ſ", "K", "²"]
#: The patterns with what stands before a match looked at first.
PLAIN = {
    D.NRIC: r"\b[STFGM]\d{7}[A-Z]\b",
    D.PHONE: r"(?<![0-9A-Za-z])(?:\+?65[\s-]?)?[3689]\d{3}[\s-]?\d{4}(?![0-9A-Za-z])",
    D.TEMP_IC: r"(?i)(?<![0-9A-Za-z])[XY](?:\d{7}|\d{10})[A-Z](?![0-9A-Za-z])",
    D.CASE_NUMBER: r"(?<![0-9A-Za-z])\d{10}[A-Za-z](?![0-9A-Za-z])",
    D.DATE_ISO: r"(?<![0-9A-Za-z])(\d{4})-(\d{2})-(\d{2})(?:[ T]\d{2}:\d{2}(?::\d{2})?)?(?![0-9A-Za-z])",
    D.DATE_NUMERIC: r"(?<![0-9A-Za-z])(\d{1,4})([/.\-])(\d{1,2})\2(\d{1,4})(?![0-9A-Za-z])",
    D.DATE_DAY_NAME: rf"(?i)(?<![0-9A-Za-z])(\d{{1,2}})(?:st|nd|rd|th)?[ \-](?:{D.MONTHS})[ ,\-]+\d{{2,4}}(?![0-9A-Za-z])",
    D.DATE_NAME_DAY: rf"(?i)(?<![A-Za-z])(?:{D.MONTHS})\.?[ \-](\d{{1,2}})(?:st|nd|rd|th)?[ ,\-]+\d{{2,4}}(?![0-9A-Za-z])",
    D.DATE_BARE_14: r"(?<![0-9A-Za-z])\d{14}(?![0-9A-Za-z])",
    D.DATE_BARE_8: r"(?<![0-9A-Za-z])\d{8}(?![0-9A-Za-z])",
}


def texts(n: int, bits: list[str], seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(n)]


def test_patterns_and_hints():
    found = 0
    for t in texts(20_000, BITS):
        for new, old in PLAIN.items():
            want = [m.span() for m in re.finditer(old, t, re.ASCII)]
            assert [m.span() for m in re.finditer(new, t, re.ASCII)] == want, (new, t)
            assert not want or re.search(D.HINTS.get(new, new), t, re.ASCII), (new, t)
            found += len(want)
        assert D.HINTS[D.EMAIL] in t or not re.search(D.EMAIL, t)
    assert found > 5000


@pytest.mark.parametrize("bare", [False, True])
def test_batches_against_columns(spark, bare):
    """ASCII texts are found whole in batches; others, and null ones, are left to the columns."""
    scanner = D.Scanner(include_bare=bare)
    rows = [*texts(1500, BITS), *texts(500, BITS + ODD, 4), None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, text string").repartition(3)
    got = df.select("k", "text", formats.found(F.col("text"), include_bare=bare).alias("a"), scanner.formats(F.col("text")).alias("b")).collect()
    assert sum(len(r.b or []) for r in got) > 500
    for r in got:
        assert (r.a is None) == (r.text is None or not r.text.isascii() or "\0" in r.text)
        assert r.a is None or r.a == r.b, r.text
    whole = {r.k: r for r in D.scanned(df, "text", scanner).collect()}
    alone = {r.k: r for r in S.once(df, "spans", scanner.scan(F.col("text"))).collect()}
    assert whole == alone


def test_empty_batches():
    assert formats.batch(pa.array([], pa.string())).to_pylist() == []
    assert formats.batch(pa.array([None, "é"])).to_pylist() == [None, None]
    assert formats.batch(pa.array(["", "no", None])).to_pylist() == [[], [], None]


def test_merge_where_nothing_overlaps(spark):
    """Layers in any order come out by their starts, as they do where some overlap."""
    span = lambda a, b, c: (a, b, c, "t" * (b - a), "sg", 0.5)
    rows = [(1, [span(5, 9, "b"), span(0, 5, "a")]), (2, [span(5, 9, "b"), span(0, 6, "a")]), (3, [span(4, 6, "b"), span(4, 6, "a")]), (4, []), (5, None)]
    got = {r.k: r.m for r in spark.createDataFrame(rows, f"k int, s {S.SPANS}").select("k", S.merge(F.col("s")).alias("m")).collect()}
    assert [(s.start, s.end, s.category) for s in got[1]] == [(0, 5, "a"), (5, 9, "b")]
    assert [(s.start, s.end, s.category) for s in got[2]] == [(0, 9, "a")]
    assert [(s.start, s.end, s.category) for s in got[3]] == [(4, 6, "b")]
    assert got[4] == [] and got[5] is None


def test_large_tables_are_dealt_to_more_tasks(spark, monkeypatch):
    """A note of a few bytes of key costs as much as a long text: tasks grow with rows, not with the file's splits."""
    monkeypatch.setattr(planted, "PER_TASK", 1000)
    notes = planted.notes(spark, "/root/testdata/sf0.001")
    assert notes.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert notes.select("k").distinct().count() == 1500
