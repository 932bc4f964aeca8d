"""Learning rules from samples: structural patterns, name lists, labelled examples."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLES = T.StructType([T.StructField(c, T.StringType()) for c in ("category", "value", "source", "context", "profile_id", "ts")])
# The characters that Python's re.escape puts a backslash before.
SPECIAL = r"[()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f]"


def tokens(sample: Column) -> Column:
    """array<struct<kind, text>>: runs of digits (d), of ASCII letters (a), and other characters one by one."""
    runs = F.regexp_extract_all(F.trim(sample), F.lit(r"(\d+|[A-Za-z]+|[\s\S])"), F.lit(1))
    return F.transform(runs, lambda t: F.struct(F.when(t.rlike(r"^\d"), "d").when(t.rlike("^[A-Za-z]"), "a").otherwise("sep").alias("kind"), t.alias("text")))


def skeleton(toks: Column) -> Column:
    """The shape: kinds, and separators as they are, without lengths."""
    return F.array_join(F.transform(toks, lambda t: F.when(t["kind"] == "sep", F.concat(F.lit("s"), t["text"])).otherwise(t["kind"])), "\u0001")


def derived_patterns(samples: DataFrame, keys: list[str], anchor: bool = True) -> DataFrame:
    """keys, pattern, n_samples, n_shapes: a pattern for each group of samples (column sample) of one shape;
    null where shapes differ. Lengths of runs are taken together by place, a group's rows pre-aggregated."""
    rows = samples.where(F.trim("sample") != "").select(*keys, tokens(F.col("sample")).alias("toks"))
    shaped = rows.withColumn("shape", skeleton(F.col("toks")))
    shapes = shaped.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.count_distinct("shape").alias("n_shapes"))
    places = shaped.select(*keys, F.posexplode("toks").alias("__k", "__t")).groupBy(*keys, "__k").agg(F.min("__t.kind").alias("__kind"), F.min("__t.text").alias("__text"), F.min(F.length("__t.text")).alias("__lo"), F.max(F.length("__t.text")).alias("__hi"))
    kind, text, lo, hi = (F.col(f"__{c}") for c in ("kind", "text", "lo", "hi"))
    cls = F.when(kind == "d", r"\d").otherwise("[A-Za-z]")
    size = F.when((lo == 1) & (hi == 1), "").when(lo == hi, F.format_string("{%d}", lo)).otherwise(F.format_string("{%d,%d}", lo, hi))
    part = F.when(kind == "sep", F.when(text.rlike(SPECIAL), F.concat(F.lit("\\"), text)).otherwise(text)).otherwise(F.concat(cls, size))
    joined = places.withColumn("__part", part).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("__k").alias("k"), F.col("__part").alias("part"), F.col("__kind").alias("kind")))).alias("__ps"))
    edge = lambda p: F.when((p["kind"] != "sep") & F.lit(anchor), r"\b").otherwise("")
    body = F.concat(edge(F.element_at("__ps", 1)), F.array_join(F.transform("__ps", lambda p: p["part"]), ""), edge(F.element_at("__ps", -1)))
    return joined.join(shapes, keys).select(*keys, F.when(F.col("n_shapes") == 1, body).alias("pattern"), "n_samples", "n_shapes")


def derived_pattern(spark, samples: Iterable[str], anchor: bool = True) -> str:
    """The pattern of a few samples; ValueError without samples or with several shapes."""
    held = [(0, s) for s in samples or [] if s and s.strip()]
    if not held:
        raise ValueError("at least one sample that isn't blank is needed")
    row = derived_patterns(spark.createDataFrame(held, "g int, sample string"), ["g"], anchor).first()
    if row.pattern is None:
        raise ValueError("samples differ in shape; give those of one shape, and a rule for each shape")
    return row.pattern


def imported_names(have: DataFrame, names: DataFrame) -> DataFrame:
    """The names (column name) that have lacks, in any case, once each: blank lines and comments left out."""
    clean = names.select(F.trim("name").alias("name")).where((F.col("name") != "") & ~F.col("name").startswith("#"))
    first = clean.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"))
    known = have.select(F.lower(F.trim("name")).alias("key")).distinct()
    return first.join(known, "key", "left_anti").select("name")


def import_counts(have: DataFrame, names: DataFrame) -> DataFrame:
    """added, skipped, total of an import."""
    clean = names.select(F.trim("name").alias("name")).where((F.col("name") != "") & ~F.col("name").startswith("#")).agg(F.count_distinct(F.lower("name")).alias("offered"))
    before = have.agg(F.count_distinct(F.lower(F.trim("name"))).alias("before"))
    added = imported_names(have, names).agg(F.count("*").alias("added"))
    return added.crossJoin(before).crossJoin(clean).select("added", (F.col("offered") - F.col("added")).alias("skipped"), (F.col("before") + F.col("added")).alias("total"))


def ner_examples(examples: DataFrame) -> DataFrame:
    """text, start, end, label, json of examples (category, value, context): the value within its context, or
    alone where the context lacks it."""
    rows = examples.withColumn("v", F.trim("value")).where("v <> ''")
    context = F.coalesce(F.nullif("context", F.lit("")), F.col("v"))
    held = F.contains(context, F.col("v"))
    out = rows.select(F.when(held, context).otherwise(F.col("v")).alias("text"), "v", F.upper(F.coalesce(F.nullif("category", F.lit("")), F.lit("PHI"))).alias("label"))
    out = out.withColumn("start", F.expr("instr(text, v) - 1")).withColumn("end", F.col("start") + F.length("v"))
    entity = F.concat(F.lit("[["), F.col("start").cast("string"), F.lit(", "), F.col("end").cast("string"), F.lit(', "'), F.col("label"), F.lit('"]]'))
    text = F.expr("substr(to_json(named_struct('text', text)), 1, length(to_json(named_struct('text', text))) - 1)")
    return out.withColumn("json", F.concat(text, F.lit(', "entities": '), entity, F.lit("}"))).drop("v")


def capture(workspace: str, profiles, category: str, value: str, profile_id: str = "default", fix: tuple[str, ...] = ("gazetteer",), pattern: str | None = None, source: str | None = None, context: str | None = None, score: float = 1.0, ts: str | None = None) -> dict:
    """Records a missed identifier: always a labelled example, and as asked a name of the project's list or a
    rule of its profile."""
    if "regex" in fix and not pattern:
        raise ValueError("fix 'regex' needs a pattern")
    os.makedirs(workspace, exist_ok=True)
    example = {"category": category, "value": value, "source": source, "context": context, "profile_id": profile_id, "ts": ts}
    with open(os.path.join(workspace, "labelled_examples.jsonl"), "a", encoding="utf-8") as f:
        f.write(json.dumps(example, ensure_ascii=False) + "\n")
    out: dict = {"labeled": True, "fix": []}
    if "gazetteer" in fix and (value or "").strip():
        folder = os.path.join(workspace, "gazetteers")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{profile_id}_custom.txt")
        held = set()
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                held = {x.strip().lower() for x in f}
        if value.strip().lower() not in held:
            with open(path, "a", encoding="utf-8") as f:
                f.write(value.strip() + "\n")
        profile = profiles.get(profile_id)
        extra = profile.setdefault("text_detection", {}).setdefault("extra_gazetteer_files", [])
        if path not in extra:
            extra.append(path)
            profiles.save(profile_id, profile)
        out["fix"].append({"type": "gazetteer", "path": path})
    if "regex" in fix:
        re.compile(pattern)
        profiles.add_rule(profile_id, category, pattern, score)
        out["fix"].append({"type": "regex", "pattern": pattern})
    return out


def tagging_categories(catalog: dict | None = None) -> list[tuple[str, str]]:
    rows = [(c["id"], c.get("label") or c["id"]) for c in (catalog or {}).get("categories") or [] if c.get("id")]
    return rows or [("names", "Names"), ("national_id", "National ID"), ("custom", "Custom")]
