"""Elements of records in long form: known values, actions, change records, crosswalks, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import pseudonyms as P
from ..functions import spans as S
from ..plans import catalog as C
from . import rules as R

SCHEMA = "file_id string, path array<struct<tag:long,item:int>>, ord int, tag long, vr string, value string, values array<string>, value_bin binary"
REWRITING = ("H", "D", "U")


def identifier_tokens(value: Column) -> Column:
    """The value and its parts of more than one character."""
    whole = F.trim(value)
    parts = F.filter(F.split(whole, r"[\^\s]+"), lambda t: F.length(t) > 1)
    return F.filter(F.array_distinct(F.concat(F.array(whole), parts)), lambda t: t != "")


def known_values(elements: DataFrame) -> DataFrame:
    """file_id, known: the identifiers at the top level of each record, whole and in parts."""
    tags = [C.tag_of(t) for t in C.KNOWN_VALUE_TAGS]
    top = elements.where(F.col("tag").isin(tags) & (F.size("path") == 0))
    pieces = top.select("file_id", F.explode(F.when(F.size("values") > 0, F.col("values")).otherwise(F.array("value"))).alias("piece")).where("piece is not null")
    return pieces.select("file_id", F.explode(identifier_tokens(F.col("piece"))).alias("token")).groupBy("file_id").agg(F.array_sort(F.collect_set("token")).alias("known"))


def patient_keys(elements: DataFrame) -> DataFrame:
    """file_id, patient: the id of the record's person, or the name where there is none."""
    top = elements.where(F.size("path") == 0)
    pick = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("value")))
    return top.where(F.col("tag").isin(0x00100020, 0x00100010)).groupBy("file_id").agg(F.coalesce(F.nullif(pick(0x00100020), F.lit("")), pick(0x00100010), F.lit("")).alias("patient"))


def deidentified(elements: DataFrame, actions: DataFrame, salt: DataFrame, profile: dict | None = None, scanner: D.Scanner | None = None) -> DataFrame:
    """Every element with its code, original, result, removed, categories and changed.

    salt is a table of one row and one column. Known values and date offsets are those of the record as it
    came in; they are joined by file, the rules broadcast, so that nothing but the two small aggregates by
    file is shuffled.
    """
    profile = profile or C.DEFAULT_PROFILE
    low, high = profile["dates"].get("offset_days_range", [-365, 365])
    truncate = int(profile["pseudonym"].get("hash_truncate", 16))
    private = profile["private_tags"]
    coded = R.dispatched(elements, actions, private.get("policy", "strip_unknown"), [C.tag_of(t) if isinstance(t, str) else t for t in private.get("allowlist") or []], (profile.get("encapsulated_pdf") or {}).get("mode", "remove"))
    full = coded.join(known_values(elements), "file_id", "left").join(patient_keys(elements), "file_id", "left").crossJoin(F.broadcast(salt.toDF("salt")))
    value = F.coalesce("value", F.lit(""))
    text = full.withColumn("scan_text", F.when(F.col("code").isin("C", "AUTO"), value))
    done = D.redacted(text, "scan_text", scanner or scanner_of(profile), "known", " ", "clean")
    days = P.date_offset(F.coalesce("patient", F.lit("")), F.col("salt"), int(low), int(high))
    code = F.col("code")
    result = (
        F.when(code.isin("X", "GONE"), F.lit(None).cast("string"))
        .when(code == "Z", "")
        .when(code == "H", P.salted(value, F.col("salt"), truncate))
        .when(code == "D", P.dummy(value, F.col("vr"), F.col("salt")))
        .when(code == "U", P.remapped_uid(value, F.col("salt")))
        .when(code == "S", F.when(F.col("vr") == "DA", P.shifted_da(value, days)).when(F.col("vr") == "DT", P.shifted_date(value, days)).otherwise(value))
        .when(code.isin("C", "AUTO"), P.closed_up(F.col("clean")))
        .otherwise(F.col("value"))
    )
    cats = F.when(F.size("spans") > 0, F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["category"]))))
    note = F.when(~code.isin("K", "X", "Z", "H", "D", "U", "S", "C", "AUTO", "NONE", "SKIP", "GONE"), F.concat(F.lit("unknown action "), code))
    out = done.select(*elements.columns, "code", value.alias("original"), result.alias("result"), code.isin("X", "GONE").alias("removed"), cats.alias("categories"), note.alias("note"))
    return out.withColumn("changed", F.when(code == "AUTO", ~F.col("result").eqNullSafe(F.col("original"))).otherwise(~code.isin("NONE", "SKIP", "GONE")))


def records(done: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The change records: actions of the map, and scans that changed something (auto)."""
    out = done.where("changed").select("file_id", "path", "ord", "tag", "vr", F.when(F.col("code") == "AUTO", "C").otherwise(F.col("code")).alias("action"), "original", "result", "removed", "categories", (F.col("code") == "AUTO").alias("auto"), "note")
    return R.with_keyword(out, words) if words is not None else out


def output_elements(done: DataFrame) -> DataFrame:
    """The elements that remain, with their new values, and the two marks that say so."""
    kept = done.where("not removed").select("file_id", "path", "ord", "tag", "vr", F.col("result").alias("value"))
    marks = done.select("file_id").distinct().select("file_id", F.explode(F.array(F.struct(F.lit(0x00120062).cast("long").alias("tag"), F.lit("CS").alias("vr"), F.lit("YES").alias("value")), F.struct(F.lit(0x00120063).cast("long").alias("tag"), F.lit("LO").alias("vr"), F.lit("veildeck: rules and layered text detection").alias("value")))).alias("m"))
    path = F.array().cast("array<struct<tag:long,item:int>>")
    return kept.where(~F.col("tag").isin(0x00120062, 0x00120063)).unionByName(marks.select("file_id", path.alias("path"), F.lit(-1).alias("ord"), "m.tag", "m.vr", "m.value"))


def change_counts(recs: DataFrame) -> DataFrame:
    """action, n of changes without kept and noted ones."""
    return recs.where("action <> 'K' and note is null").groupBy("action").agg(F.count("*").alias("n"))


def crosswalk(recs: DataFrame, reversible: bool = True) -> DataFrame:
    """pseudonym, category, original of hashed, dummied and remapped values; empty unless reversible."""
    rows = recs.where(F.col("action").isin(*REWRITING) & (F.coalesce("original", F.lit("")) != "") & (F.coalesce("result", F.lit("")) != "") & F.lit(reversible))
    return rows.groupBy(F.col("result").alias("pseudonym")).agg(F.max(F.struct(F.lower(F.hex("tag")).alias("category"), "original")).alias("x")).select("pseudonym", "x.category", "x.original")


def reidentified(pseudonyms: DataFrame, walk: DataFrame) -> DataFrame:
    """pseudonyms with category and original, null where unknown."""
    return pseudonyms.join(walk, "pseudonym", "left")


def scanner_of(profile: dict, names: tuple[str, ...] = (), spark: SparkSession | None = None) -> D.Scanner:
    td = profile.get("text_detection") or {}
    kept, _ = D.compiled_rules(td.get("custom_regex") or [], spark)
    return D.Scanner(gazetteer=names, custom=tuple(kept), detect_dates=bool(td.get("detect_dates", True)), include_bare=bool(td.get("dates_include_bare", False)))


def metadata_view(elements: DataFrame, words: DataFrame) -> DataFrame:
    """A flat view to read: one level of sequences, bulk values as sizes, several values joined by a backslash."""
    shown = elements.where(F.size("path") <= 1)
    value = (
        F.when(F.col("vr") == "SQ", F.concat(F.lit("<Sequence: "), F.coalesce(F.col("value"), F.lit("0")), F.lit(" item(s)>")))
        .when(F.col("vr").isin(*C.BULK_VRS) | (F.col("tag") == C.PIXEL_DATA), F.concat(F.lit("<"), F.coalesce(F.length("value_bin"), F.lit(0)).cast("string"), F.lit(" bytes>")))
        .when(F.size("values") > 0, F.array_join("values", "\\"))
        .otherwise(F.coalesce("value", F.lit("")))
    )
    named = shown.join(F.broadcast(words.select("tag", "keyword")), "tag", "left")
    return named.select("file_id", "path", "ord", "tag", R.tag_text(F.col("tag")).alias("tag_text"), F.coalesce("keyword", R.tag_text(F.col("tag"))).alias("keyword"), "vr", value.alias("value"), F.size("path").alias("depth"))


def masked_view(view: DataFrame, findings: DataFrame, least: float = 0.5) -> DataFrame:
    """The view with values masked under every tag that has a finding of that score in the file."""
    flagged = findings.where(F.col("score") >= least).select("file_id", "tag").distinct().withColumn("flag", F.lit(True))
    out = view.join(flagged, ["file_id", "tag"], "left").withColumn("flagged", F.coalesce("flag", F.lit(False)))
    return out.withColumn("value", F.when(F.col("flagged"), P.masked(F.col("value"))).otherwise(F.col("value"))).drop("flag")


def text_values(elements: DataFrame, words: DataFrame) -> DataFrame:
    """file_id, tag, keyword, text: a row for each value of a text element, at any depth, blank ones left out."""
    rows = elements.where(F.col("vr").isin(*C.TEXT_VRS)).select("file_id", "tag", F.explode(F.when(F.size("values") > 0, F.col("values")).otherwise(F.array("value"))).alias("text"))
    return R.with_keyword(rows.withColumn("text", F.trim("text")).where("text <> ''"), words)


def without_waveforms(elements: DataFrame) -> DataFrame:
    return elements.where((F.col("tag") != C.WAVEFORM_SEQUENCE) & ~F.exists("path", lambda p: p["tag"] == C.WAVEFORM_SEQUENCE))


def filename_parts(name: Column) -> tuple[Column, Column]:
    """Stem and extension; .nii.gz is one extension."""
    ext = F.regexp_extract(name, r"(?i)(\.nii\.gz|(?<=[^.])\.[^.]*)$", 1)
    return F.substring(name, 1, F.length(name) - F.length(ext)), ext


def sanitised_names(names: DataFrame, scanner: D.Scanner, salt: DataFrame, truncate: int = 16, known: str | None = None) -> DataFrame:
    """names (column name) with clean: tokens that are an identifier hashed whole, others where they hold one.

    Separators and the extension stay; all of it is done within the row."""
    stem, ext = filename_parts(F.col("name"))
    tokens = F.regexp_extract_all(stem, F.lit(r"([_\-.\s]+|[^_\-.\s]+)"), F.lit(1))
    rows = names.crossJoin(F.broadcast(salt.toDF("__salt"))).withColumn("__t", tokens)
    found = rows.withColumn("__raw", F.transform("__t", lambda t: F.struct(t.alias("t"), scanner.raw(t, F.col(known) if known else None).alias("s"))))
    held = found.withColumn("__held", F.transform("__raw", lambda x: F.struct(x["t"].alias("t"), S.merge(x["s"]).alias("s"))))
    hashed = lambda x: P.salted(x, F.col("__salt"), truncate)

    def new(x: Column) -> Column:
        whole = F.exists(x["s"], lambda s: (s["end"] - s["start"]) >= F.length(x["t"]))
        return F.when(F.size(x["s"]) == 0, x["t"]).when(whole, hashed(x["t"])).otherwise(S.rewrite(x["t"], x["s"], lambda s: hashed(s["text"])))

    return held.withColumn("clean", F.concat(F.array_join(F.transform("__held", new), ""), ext)).drop("__t", "__raw", "__held", "__salt")
