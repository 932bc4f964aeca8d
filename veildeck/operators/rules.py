"""Rule resolution: tags and their actions, and what happens to each element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import catalog as C

TAG = r"\(\s*([0-9A-Fa-f]{4})\s*,\s*([0-9A-Fa-f]{4})\s*\)"


def parsed_tag(text: Column) -> Column:
    """(gggg,eeee) as one number, null without one."""
    both = F.concat(F.regexp_extract(text, TAG, 1), F.regexp_extract(text, TAG, 2))
    return F.when(both != "", F.conv(both, 16, 10).cast("long"))


def is_private(tag: Column) -> Column:
    return F.shiftright(tag, 16) % 2 == 1


def tag_text(tag: Column) -> Column:
    h = F.lpad(F.hex(tag), 8, "0")
    return F.concat(F.lit("("), F.substring(h, 1, 4), F.lit(","), F.substring(h, 5, 4), F.lit(")"))


def date_action(mode: str | None) -> str:
    return C.DATE_ACTIONS.get(mode or "remove", "X")


def catalog_rows(spark: SparkSession, catalog: dict | None = None) -> DataFrame:
    """A row for each category and tag, in the catalog's order; order decides which of two rules holds."""
    catalog = catalog or C.default_catalog()
    rows = [(k, c["id"], c.get("action", "X"), t) for k, c in enumerate(catalog.get("categories") or []) for t in c.get("dicom_tags") or []]
    uid = catalog.get("uid_remap") or {}
    rows += [(10_000, "uid_remap", uid.get("action", "U"), t) for t in uid.get("tags") or []]
    rows += [(-1, "free_text", "C", t) for t in C.FREE_TEXT_TAGS]
    return spark.createDataFrame(rows, "ord int, category string, action string, tag_text string")


def action_map(rows: DataFrame, mode: str | None = None) -> DataFrame:
    """tag, action: of a tag's rows the last holds, free-text defaults only where there is no other."""
    resolved = rows.select(parsed_tag(F.col("tag_text")).alias("tag"), "ord", F.when(F.col("action") == "profile_dates", date_action(mode)).otherwise(F.col("action")).alias("action"))
    return resolved.where("tag is not null").groupBy("tag").agg(F.max_by("action", "ord").alias("action"))


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.dictionary(), "tag long, keyword string, vr string")


def dispatched(elements: DataFrame, actions: DataFrame, policy: str = "strip_unknown", allowlist: list[int] | None = None, pdf_mode: str = "remove") -> DataFrame:
    """elements with code: what is to be done to each.

    Elements are file_id, path (array of struct<tag, item>), ord, tag, vr, value. Codes are those of the
    map; AUTO is a scan of text without a rule, NONE leaves as is, SKIP is an embedded document that a
    later step rewrites. Elements below a sequence that is removed or blanked get GONE.
    """
    scan = F.col("vr").isin(*C.TEXT_VRS)
    keep = F.lit(policy == "keep_all") | F.col("tag").isin(list(allowlist or []))
    own = elements.join(F.broadcast(actions), "tag", "left")
    code = (
        F.when((F.col("tag") == C.ENCAPSULATED_DOCUMENT) & (F.lit(pdf_mode) == "rasterize_redact"), "SKIP")
        .when((F.col("vr") == "SQ") & F.col("action").isin("X", "Z"), F.col("action"))
        .when(F.col("vr") == "SQ", "NONE")
        .when(F.col("action").isNotNull(), F.col("action"))
        .when(is_private(F.col("tag")), F.when(keep, F.when(scan, "AUTO").otherwise("NONE")).otherwise("X"))
        .when(scan, "AUTO")
        .otherwise("NONE")
    )
    coded = own.withColumn("code", code).drop("action")
    if "path" not in elements.columns:
        return coded
    # Prefixes of a path are few, and only elements within sequences have any.
    seq = coded.where((F.col("vr") == "SQ") & F.col("code").isin("X", "Z")).select(F.col("file_id").alias("seq_file"), F.col("path").alias("seq_path"), F.col("tag").alias("seq_tag")).distinct()
    inner = coded.where(F.size("path") > 0).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("path"))))
    inner = inner.withColumn("above", F.slice("path", 1, F.col("k") - 1)).withColumn("above_tag", F.element_at("path", F.col("k"))["tag"])
    gone = inner.join(seq, (F.col("file_id") == F.col("seq_file")) & (F.col("above") == F.col("seq_path")) & (F.col("above_tag") == F.col("seq_tag")), "left_semi").select("file_id", "path", "ord", "tag").distinct().withColumn("gone", F.lit(True))
    return coded.join(gone, ["file_id", "path", "ord", "tag"], "left").withColumn("code", F.when(F.col("gone"), "GONE").otherwise(F.col("code"))).drop("gone").select(*elements.columns, "code")


def keyword_action(keys: Column, actions: DataFrame, words: DataFrame, mode: str | None = None) -> DataFrame:
    """keyword, action of JSON keys: the tag's own action, else the date policy for date VRs."""
    found = words.join(F.broadcast(actions), "tag", "left")
    act = F.coalesce(F.col("action"), F.when(F.col("vr").isin(*C.DATE_VRS), date_action(mode)))
    return found.select("keyword", act.alias("action")).where("action is not null")


def with_keyword(records: DataFrame, words: DataFrame) -> DataFrame:
    """records with the keyword of their tag, in hex if there is none."""
    named = words.select("tag", "keyword")
    return records.join(F.broadcast(named), "tag", "left").withColumn("keyword", F.coalesce("keyword", F.concat(F.lit("0x"), F.lower(F.hex("tag")))))


def shortened(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def diff_table(records: DataFrame) -> DataFrame:
    """What a reviewer sees of the changes: hex tag, both values cut short, categories in one text."""
    result = F.when(F.coalesce(F.col("removed"), F.lit(False)), "(removed)").otherwise(F.coalesce(F.col("result"), F.lit("")))
    return records.select(
        F.concat(F.lit("0x"), F.lpad(F.hex("tag"), 8, "0")).alias("tag_hex"), "action", shortened(F.coalesce("original", F.lit(""))).alias("original"), shortened(result).alias("result"), F.array_join(F.coalesce("categories", F.array().cast("array<string>")), ", ").alias("detected")
    )


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
