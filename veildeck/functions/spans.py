"""Spans of text as columns: find all matches with offsets, merge overlaps, rewrite. No user functions.

A span is a struct<start,end,category,text,source,score>: half-open, in code points. All matches of a
pattern are found by wrapping each in two private-use characters, splitting there and adding up lengths;
those characters are first replaced in the input by others of the same length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,category:string,text:string,source:string,score:double>"
SPANS = f"array<{SPAN}>"
OPEN, CLOSE, NEITHER = "", "", "��"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a costly column that is computed once a row, however often it is used above.

    As the output of a generator it isn't put in place of its name in later filters and projections, as the
    optimizer would do with a plain column: two scans in a row would otherwise multiply."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, category, text: Column, source: str, score) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), as_col(category).alias("category"), text.alias("text"), F.lit(source).alias("source"), as_col(score).cast("double").alias("score"))


def find(text: Column, pattern: Column | str, make: Callable[[Column, Column, Column], Column], valid: Callable[[Column], Column] | None = None, hint: str | None = None) -> Column:
    """The spans make(start, end, match) of all matches of a pattern, those that are not valid left out.

    valid sees the match alone. The pattern may be a column, with another value in each row. hint is a cheaper
    pattern that every text with a match has; without one the pattern itself is asked first."""
    # Translating costs more than a search, so only texts that hold a mark are translated.
    clean = F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, NEITHER)).otherwise(text)
    rx = pattern if isinstance(pattern, Column) else F.lit(pattern)
    # One mark on both sides: every second part is a match, and splitting at one character takes no pattern.
    parts = F.split(F.regexp_replace(clean, rx, F.lit(f"{OPEN}$0{OPEN}")), OPEN)
    state = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("found"))

    def step(s: Column, part: Column) -> Column:
        end = s["at"] + F.length(part)
        hit = F.array(F.struct(s["at"].alias("start"), end.alias("end"), part.alias("text")))
        return F.struct(end.alias("at"), (~s["inside"]).alias("inside"), F.when(s["inside"] & (F.length(part) > 0), F.concat(s["found"], hit)).otherwise(s["found"]).alias("found"))

    def spans(p: Column) -> Column:
        found = F.aggregate(p, state, step, lambda s: s["found"])
        if valid is not None:
            found = F.filter(found, lambda m: valid(m["text"]))
        # One match, the usual number, is put together without a fold.
        one = F.get(p, F.lit(1))
        start = F.length(F.get(p, F.lit(0)))
        fits = F.length(one) > 0 if valid is None else (F.length(one) > 0) & valid(one)
        return F.when(F.size(p) > 3, F.transform(found, lambda m: make(m["start"], m["end"], m["text"]))).when((F.size(p) == 3) & fits, F.array(make(start, start + F.length(one), one))).otherwise(no_spans())

    # A text without a match, nearly all of them, costs one search.
    has = F.regexp_like(text, rx) if isinstance(pattern, Column) else text.rlike(hint or pattern)
    return F.when(has, let(parts, spans)).otherwise(no_spans())


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def without_overlaps(spans: Column) -> Column:
    """Spans in order of precedence, each that overlaps an accepted one left out."""
    return F.aggregate(spans, no_spans(), lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.concat(kept, F.array(s))))


def merge(spans: Column) -> Column:
    """Overlapping spans as one: the union of their bounds, the higher score, and the category, text and
    source of the longer one (of equal ones the higher score, then the first)."""

    def before(a: Column, b: Column) -> Column:
        size = lambda s: s["end"] - s["start"]
        return (
            F.when(a["start"] != b["start"], a["start"] - b["start"])
            .when(size(a) != size(b), size(b) - size(a))
            .when(a["score"] > b["score"], F.lit(-1))
            .when(a["score"] < b["score"], F.lit(1))
            .otherwise(F.lit(0))
        )

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wide = lambda x: F.struct((x["end"] - x["start"]).alias("n"), x["score"].alias("score"))
        kept = F.when(wide(last) >= wide(s), last).otherwise(s)
        one = F.struct(
            F.least(last["start"], s["start"]).alias("start"),
            F.greatest(last["end"], s["end"]).alias("end"),
            kept["category"].alias("category"),
            kept["text"].alias("text"),
            kept["source"].alias("source"),
            F.greatest(last["score"], s["score"]).alias("score"),
        )
        return F.when(overlaps(last, s), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(s)))

    # Where nothing overlaps, the usual case, spans in order of their starts are the answer; `last` is the end so far.
    apart = lambda x: F.aggregate(x, F.lit(0), lambda last, s: F.when((s["start"] >= last) & (s["end"] > s["start"]), s["end"])).isNotNull()
    merged = let(F.sort_array(spans), lambda x: F.when(apart(x), x).otherwise(F.aggregate(F.array_sort(spans, before), no_spans(), step)))
    return F.when(F.size(spans) <= 1, spans).otherwise(merged)


def rewrite(text: Column, spans: Column, replacement: Callable[[Column], Column] | str = "[REDACTED]") -> Column:
    """text with each of the merged spans replaced."""
    new = replacement if callable(replacement) else lambda _s: F.lit(replacement)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), new(x)).alias("out"))

    done = F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
