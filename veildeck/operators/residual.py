"""Residual scans of outputs: findings, verdicts for each file and batch, survivors, acceptance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import pseudonyms as P
from ..plans import catalog as C

# Categories whose planted values are literals.
LITERAL_CATEGORIES = ("names", "nric_fin", "temp_ic", "case_number", "passport", "phone", "email", "dates", "mrn", "accession", "address")


def confident(source: Column, score: Column, least: float = 0.5, least_other: float = 0.9) -> Column:
    """Findings of exact layers count from `least`, those of others from `least_other`."""
    return score >= F.when(source.isin(*D.CONFIDENT_SOURCES), least).otherwise(least_other)


def findings(texts: DataFrame, scanner: D.Scanner | None = None, least: float = 0.5, least_other: float = 0.9) -> DataFrame:
    """A row for each span of the values (file_id, tag, keyword, text) of outputs, with a masked preview.

    No header tokens are looked for: an output's own pseudonyms are not findings. Values that say how the
    record was treated are passed over."""
    rows = D.scanned(texts.where(~F.col("tag").isin(*C.PROVENANCE_TAGS)), "text", scanner or D.Scanner())
    one = rows.select("file_id", F.lit("metadata").alias("location"), "tag", "keyword", F.explode_outer("spans").alias("s")).where("s is not null")
    return one.select("file_id", "location", "tag", "keyword", "s.category", "s.source", "s.score", P.masked(F.col("s.text")).alias("preview"), confident(F.col("s.source"), F.col("s.score"), least, least_other).alias("confident"))


def by_category(found: DataFrame) -> DataFrame:
    return found.groupBy("file_id", "category").agg(F.count("*").alias("n"))


def verdicts(files: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each file scanned: counts, categories and passed. files: file_id, identity_removed, skipped."""
    sums = found.groupBy("file_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("location") == "metadata").alias("metadata"), F.count_if(F.col("location") == "pixels").alias("pixels"), F.count_if("confident").alias("n_confident"), F.array_sort(F.collect_set("category")).alias("categories")
    )
    out = files.join(sums, "file_id", "left").fillna(0, ["total", "metadata", "pixels", "n_confident"])
    return out.withColumn("passed", F.when(F.col("skipped").isNull(), F.col("n_confident") == 0))


def batch(verdict: DataFrame) -> DataFrame:
    """One row: files scanned, passed, flagged and skipped, findings; a file that can't be read fails nothing."""
    return verdict.agg(
        F.count_if(F.col("skipped").isNull()).alias("scanned"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_flagged"), F.count_if(F.col("skipped").isNotNull()).alias("n_skipped"), F.coalesce(F.sum("total"), F.lit(0)).alias("findings"), F.coalesce(F.sum("n_confident"), F.lit(0)).alias("n_confident")
    ).withColumn("passed", F.col("n_flagged") == 0)


def category_rollup(found: DataFrame) -> DataFrame:
    """Findings for each file and category and, with a null file, for the batch: two grouping sets."""
    return found.groupingSets([["file_id", "category"], ["category"]], "file_id", "category").agg(F.count("*").alias("n"))


def qa_files(verdict: DataFrame) -> DataFrame:
    name = F.regexp_extract("file_id", r"([^/\\]*)$", 1)
    removed = F.when(F.col("identity_removed").isNull(), "n/a").when(F.col("identity_removed"), "yes").otherwise("NO")
    return verdict.select(name.alias("file"), F.col("total").alias("findings"), F.col("n_confident").alias("confirmed"), F.array_join(F.coalesce("categories", F.array().cast("array<string>")), ", ").alias("categories"), removed.alias("identity_removed"), F.when(F.coalesce("passed", F.lit(False)), "PASS").otherwise("FLAG").alias("verdict"))


def qa_findings(found: DataFrame) -> DataFrame:
    return found.select(F.regexp_extract("file_id", r"([^/\\]*)$", 1).alias("file"), "location", F.col("keyword").alias("field"), "category", "source", "score", F.when(F.col("confident"), "confirmed").otherwise("review").alias("confidence"), "preview")


#: Planted literals at most.
MOST_LITERALS = 10_000


def survivors(texts: DataFrame, planted: DataFrame) -> DataFrame:
    """category, value of planted literals that some output (file_id, text) still holds.

    Planted literals are a list made by hand, checked to be small before it goes to every executor, where one
    automaton finds all of them in a single pass over each text; name separators count as spaces, in the
    file's name too."""
    known = planted.where(F.col("category").isin(*LITERAL_CATEGORIES) & (F.coalesce("value", F.lit("")) != "")).select("category", "value").distinct().limit(MOST_LITERALS + 1).collect()
    if len(known) > MOST_LITERALS:
        raise ValueError("planted literals are a short list; use operators.gazetteer for long ones")
    name = F.regexp_replace(F.regexp_extract("file_id", r"([^/\\]*)$", 1), r"[_\-.]+", " ")
    norm = texts.select(F.translate(F.concat_ws(" ", "text", name), "^=", "  ").alias("norm"))
    owners: dict[str, list[str]] = {}
    for r in known:
        owners.setdefault(r.value, []).append(r.category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, met = _finder(list(owners)), set()
        for b in batches:
            for t in b.column(0).to_pylist():
                met.update(find(t))
        rows = [(c, v) for v in sorted(met) for c in owners[v]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], ["category", "value"])

    return norm.mapInArrow(run, "category string, value string").distinct()


def _finder(values: list[str]):
    """A function of a text to those of the values that it holds."""
    if not values:
        return lambda text: ()
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [v for v in values if v in text]
    automaton = ahocorasick.Automaton()
    for v in values:
        automaton.add_word(v, v)
    automaton.make_automaton()
    return lambda text: {v for _, v in automaton.iter(text)}


def survivor_report(left: DataFrame) -> DataFrame:
    return left.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("survivors"), F.count_distinct("value").alias("n"))


def acceptance(checks: DataFrame) -> DataFrame:
    """One row over checks (name, passed): how many, how many passed, and whether all did."""
    return checks.agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"), F.bool_and("passed").alias("passed"))


CHECKS = ("every input has an output", "no planted value is left", "detectors find nothing for certain", "outputs can be read", "reversible only if asked", "a second run has nothing to do", "faces removed where they can be")


def face_counts(files: DataFrame) -> DataFrame:
    """One row over files (file_id, defaced or null, reason, deface_error or null): records, defaced, errors and
    whether none failed. A skip with a reason is no failure."""
    return files.agg(F.count("defaced").alias("n_records"), F.count_if(F.coalesce("defaced", F.lit(False))).alias("n_defaced"), F.count("deface_error").alias("n_errors")).withColumn("ok", F.col("n_errors") == 0)


def reprocessed(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row, n: files that a second run over the same inputs would take up again, though the first one
    finished them. Both are manifests (input_path, status)."""
    done = first.where(F.col("status").isin("done", "flagged")).select("input_path")
    return second.where("status = 'pending'").join(done, "input_path", "left_semi").agg(F.count("*").alias("n"))


def distinct_notes(reports: DataFrame) -> DataFrame:
    """note: each text, once, that some report (notes: an array, or null) holds."""
    return reports.select(F.explode("notes").alias("note")).where("note is not null and note <> ''").distinct()


def acceptance_checks(inputs: DataFrame, outputs: DataFrame, survived: DataFrame, summary: DataFrame, unreadable: DataFrame, walk: DataFrame, again: DataFrame, faces: DataFrame, mode: str = "irreversible") -> DataFrame:
    """name, passed and detail of the seven checks of a run, in one plan over its tables.

    inputs and outputs have file_id, survived what survivors() gives, summary what batch() does, unreadable a
    row for each output that can't be read again, walk the crosswalk that was kept (pseudonym, original, and
    restored, what the keystore gives back), again what reprocessed() gives, faces what face_counts() does."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    missing = n(inputs.select("file_id").distinct().join(outputs.select("file_id").distinct(), "file_id", "left_anti"), "missing")
    kept = survivor_report(survived).agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "category", "survivors"))), "; "), F.lit("")).alias("kept"))
    crosswalk = walk.agg(F.count("*").alias("n_walk"), F.coalesce(F.bool_and(F.col("restored").eqNullSafe(F.col("original"))), F.lit(True)).alias("restored"))
    counts = [n(inputs, "n_in"), missing, kept, summary.select(F.col("passed").alias("clean"), "n_flagged", "scanned"), n(unreadable, "n_bad"), crosswalk, again.select(F.col("n").alias("n_again")), faces]
    one = counts[0]
    for df in counts[1:]:  # each has one row
        one = one.crossJoin(df)
    reversible = F.col("n_walk") == 0 if mode == "irreversible" else F.col("restored") & (F.col("n_walk") > 0)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    rows = [
        ((F.col("n_in") > 0) & (F.col("missing") == 0), text(F.col("missing"), " without output")),
        (F.col("kept") == "", F.col("kept")),
        (F.coalesce("clean", F.lit(False)), text(F.col("n_flagged"), " of ", F.col("scanned"), " flagged")),
        (F.col("n_bad") == 0, text(F.col("n_bad"), " unreadable")),
        (reversible, text(mode, ", ", F.col("n_walk"), " in the crosswalk")),
        (F.col("n_again") == 0, text(F.col("n_again"), " taken up again")),
        (F.col("ok"), text(F.col("n_records"), " records, ", F.col("n_defaced"), " defaced, ", F.col("n_errors"), " errors")),
    ]
    made = F.array(*[F.struct(F.lit(c).alias("name"), p.alias("passed"), d.cast("string").alias("detail")) for c, (p, d) in zip(CHECKS, rows, strict=True)])
    return one.select(F.explode(made).alias("c")).select("c.*")


def report(checks: DataFrame) -> str:
    """The checks as Markdown."""
    rows = checks.collect()
    verdict = "PASS" if all(r.passed for r in rows) else "FAIL"
    return "\n".join([f"# Acceptance: {verdict} {sum(r.passed for r in rows)}/{len(rows)}", "", "| check | result | detail |", "|-|-|-|", *(f"| {r.name} | {'PASS' if r.passed else 'FAIL'} | {r.detail} |" for r in rows)])
