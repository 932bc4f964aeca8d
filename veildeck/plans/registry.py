"""The named queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..functions import pseudonyms as P
from ..functions import spans as S
from ..operators import arrays, elements, gazetteer, governance, learning, manifest, models, residual, rules, sidecars
from . import catalog as C
from . import planted as X

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


NOTES, LETTER = X.NOTES_SQL, X.LETTER_SQL
PROFILE_SHIFT = {**C.DEFAULT_PROFILE, "dates": {"mode": "shift", "offset_days_range": [-30, 30]}}
SHA = lambda x: f"sha256('{X.SALT}' || {x})"
OFFSET = lambda x: f"(-30 + (('0x' || substr(sha256('{X.SALT}' || '|date|' || {x}), 1, 16))::UBIGINT % 61)::INT)"
MASK = lambda x: f"CASE WHEN length({x}) <= 2 THEN repeat('•', length({x})) ELSE left({x}, 1) || repeat('•', length({x}) - 2) || right({x}, 1) END"

# --- detection


@query(f"WITH {NOTES} SELECT k, nric AS value, CASE WHEN substr(nric, 9, 1) = {LETTER} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM t")
def nric_score(spark: SparkSession, sf: str) -> DataFrame:
    found = X.notes(spark, sf).select("k", F.explode(D.nric(F.col("text"))).alias("s"))
    return found.select("k", F.col("s.text").alias("value"), "s.score")


@query(f"""WITH {NOTES}, s AS (SELECT unnest(['nric_fin', 'phone', 'email', 'case_number', 'date']) AS category FROM t) SELECT category, count(*)::BIGINT AS n FROM s GROUP BY category""")
def scan_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return D.scanned(X.notes(spark, sf), "text").select(F.explode("spans.category").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def _at(*before: str) -> str:
    return " + ".join(f"length({b})" for b in before) or "0"


_PIECES = ["'Seen '", "nric", "' call '", "phone", "' mail '", "mail", "', case '", "kase", "' on '", "iso"]
_OFFSETS = " || ',' || ".join(f"'{c}:' || ({_at(*_PIECES[:k])}) || ':' || ({_at(*_PIECES[: k + 1])})" for c, k in [("nric_fin", 1), ("phone", 3), ("email", 5), ("case_number", 7), ("date", 9)])


@query(f"WITH {NOTES} SELECT k, {_OFFSETS} AS spans FROM t")
def scan_spans(spark: SparkSession, sf: str) -> DataFrame:
    return D.scanned(X.notes(spark, sf), "text").select("k", sidecars.spans_as_text(F.col("spans")).alias("spans"))


@query(f"WITH {NOTES} SELECT k, 'Seen [REDACTED] call [REDACTED] mail [REDACTED], case [REDACTED] on [REDACTED].' AS redacted FROM t")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    return D.redacted(X.notes(spark, sf), "text").select("k", "redacted")


@query(f"WITH {NOTES}, o AS (SELECT k, length(nric) AS n FROM t) SELECT k, 5::BIGINT AS at, (5 + n + 5)::BIGINT AS til, 'custom' AS category, 1.0::DOUBLE AS score, (5 + n)::BIGINT AS raw_end FROM o")
def merge_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """A number and a longer custom phrase over it become one span, under the longer one's label: the first
    merged span of a whole note, as the twin gives it. merge_overlaps_all gives them all."""
    scanner = D.Scanner(custom=(D.CustomRule(r"S\d{7}[A-Z] call\b", score=0.6),), detect_dates=False)
    rows = D.raw(X.notes(spark, sf).select("k", "text"), "text", scanner)
    one = S.once(rows, "merged", S.merge(F.col("raw"))).select("k", "raw", F.get("merged", F.lit(0)).alias("m"))
    first = F.element_at(F.filter("raw", lambda s: s["source"] == "sg"), 1)
    # The union's score is the higher one; a valid number's is 1, and so is never below the phrase's.
    return one.select("k", F.col("m.start").cast("long").alias("at"), F.col("m.end").cast("long").alias("til"), "m.category", F.when(F.col("m.score") >= 0.6, 1.0).otherwise(0.0).alias("score"), first["end"].cast("long").alias("raw_end"))


def _all_merged() -> str:
    rows = [
        (_at(*_PIECES[:1]), _at(*_PIECES[:2], "' call'"), "'custom'", f"CASE WHEN substr(nric, 9, 1) = {LETTER} THEN 1.0 ELSE 0.6 END"),
        (_at(*_PIECES[:3]), _at(*_PIECES[:4]), "'phone'", "0.9"),
        (_at(*_PIECES[:5]), _at(*_PIECES[:6]), "'email'", "1.0"),
        (_at(*_PIECES[:6], "', '"), _at(*_PIECES[:8]), "'custom'", "0.7"),
        (_at(*_PIECES[:9]), _at(*_PIECES[:10]), "'date'", "0.85"),
    ]
    return f"WITH {NOTES} " + " UNION ALL ".join(f"SELECT k, ({at})::BIGINT AS at, ({til})::BIGINT AS til, {category} AS category, ({score})::DOUBLE AS score FROM t" for at, til, category, score in rows)


@query(_all_merged())
def merge_overlaps_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every merged span of every note: phrases over the number and over the case number, the rest alone."""
    scanner = D.Scanner(custom=(D.CustomRule(r"S\d{7}[A-Z] call\b", score=0.6), D.CustomRule(r"case \d{10}B\b", score=0.6)))
    found = D.scanned(X.notes(spark, sf), "text", scanner).select("k", F.explode("spans").alias("s"))
    return found.select("k", F.col("s.start").cast("long").alias("at"), F.col("s.end").cast("long").alias("til"), "s.category", "s.score")


_DATES = """WITH d AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders),
v AS (SELECT k, CASE k % 6 WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(d, '%d %b %Y') WHEN 3 THEN strftime(d, '%B %d, %Y') WHEN 4 THEN strftime(d, '%Y.%m.%d') ELSE strftime(d, '%Y%m%d') END AS v, CASE k % 6 WHEN 1 THEN 0.85 WHEN 0 THEN 0.8 WHEN 4 THEN 0.8 WHEN 5 THEN 0.6 ELSE 0.9 END::DOUBLE AS score FROM d)
SELECT k, v AS value, score FROM v"""


@query(_DATES)
def date_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric, ISO, month-name and bare dates, each in a sentence with things that only look like dates."""
    forms = ["dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "dd MMM yyyy", "MMMM dd, yyyy", "yyyy.MM.dd", "yyyyMMdd"]
    text = F.coalesce(*[F.when(F.col("k") % 6 == i, F.date_format("d", f)) for i, f in enumerate(forms)])
    rows = X.notes(spark, sf).select("k", F.concat(F.lit("ratio 1-2/3, v99.99.99 on "), text, F.lit(" (x2024-01-01y)")).alias("text"))
    return rows.select("k", F.explode(D.dates(F.col("text"), include_bare=True)).alias("s")).select("k", F.col("s.text").alias("value"), "s.score")


@query("SELECT c_custkey AS key, 4 AS start, (4 + length(n_name))::INT AS \"end\", n_name AS text FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, (4 + length(n_name) + 4)::INT, (8 + 2 * length(n_name))::INT, lower(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def gazetteer_match(spark: SparkSession, sf: str) -> DataFrame:
    names = X.table(spark, sf, "nation").selectExpr("n_name as name", "n_nationkey")
    texts = X.table(spark, sf, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey as key", "concat('met ', name, ' or ', lower(name), '7 not x', name) as text")
    texts = texts.selectExpr("key", "replace(text, '7 not', ', not') as text")
    return gazetteer.hits(texts, names)


@query("SELECT c_custkey AS k, 'Echo of [REDACTED], id [REDACTED] not XID' || c_custkey || '.' AS redacted, 'name,id' AS categories FROM customer")
def header_scrub(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "customer").selectExpr("c_custkey as k", "concat('Echo of ', upper(c_name), ', id ID', c_custkey, ' not XID', c_custkey, '.') as text", "array(c_name, concat('ID', c_custkey)) as known")
    done = D.redacted(rows, "text", D.Scanner(detect_dates=False), "known")
    return done.select("k", "redacted", F.array_join("spans.category", ",").alias("categories"))


@query("SELECT p_partkey AS k, p_brand AS value, 0.75::DOUBLE AS score FROM part")
def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = D.compiled_rules([{"category": "brand", "pattern": r"Brand#\d+", "score": 0.75}, {"category": "bad", "pattern": "("}, {"pattern": "x*"}], spark)
    rows = X.table(spark, sf, "part").selectExpr("p_partkey as k", "concat('the ', p_brand, '.') as text")
    return rows.select("k", F.explode(D.custom(F.col("text"), kept)).alias("s")).select("k", F.col("s.text").alias("value"), "s.score")


# --- rules

_CATALOG_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(
    [f"({k}, '{a}', {C.tag_of(t)})" for k, (_, _, a, tags) in enumerate(C.CATEGORIES) for t in tags] + [f"(10000, 'U', {C.tag_of(t)})" for t in C.UID_TAGS] + [f"(-1, 'C', {C.tag_of(t)})" for t in C.FREE_TEXT_TAGS]
) + ") AS x(ord, action, tag))"
_MAP = lambda date: f"{_CATALOG_SQL}, m AS (SELECT tag::BIGINT AS tag, CASE WHEN arg_max(action, ord) = 'profile_dates' THEN '{date}' ELSE arg_max(action, ord) END AS action FROM c GROUP BY tag)"


@query(f"WITH {_MAP('X')} SELECT tag, action FROM m")
def action_map(spark: SparkSession, sf: str) -> DataFrame:
    return rules.action_map(rules.catalog_rows(spark), "remove")


_DISPATCH = f"{X.elements_sql()}, {_MAP('S')}, s AS (SELECT e.*, CASE WHEN parent = {C.WAVEFORM_SEQUENCE} THEN 'GONE' WHEN vr = 'SQ' AND action IN ('X', 'Z') THEN action WHEN vr = 'SQ' THEN 'NONE' WHEN action IS NOT NULL THEN action WHEN (e.tag >> 16) % 2 = 1 THEN 'X' WHEN vr IN ('LO', 'SH', 'ST', 'LT', 'UT', 'PN', 'UC') THEN 'AUTO' ELSE 'NONE' END AS code FROM e LEFT JOIN m ON e.tag = m.tag)"


@query(f"WITH {_DISPATCH} SELECT file_id, ord::INT AS ord, tag, code FROM s")
def element_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    actions = rules.action_map(rules.catalog_rows(spark), "shift")
    return rules.dispatched(X.elements(spark, sf), actions).select("file_id", "ord", "tag", "code")


@query(f"WITH {X.elements_sql()} SELECT file_id, tag, CASE WHEN tag = {0x00091001} THEN 'AUTO' ELSE 'X' END AS code FROM e WHERE (tag >> 16) % 2 = 1")
def private_policy(spark: SparkSession, sf: str) -> DataFrame:
    actions = rules.action_map(rules.catalog_rows(spark), "shift")
    done = rules.dispatched(X.elements(spark, sf), actions, allowlist=[0x00091001])
    return done.where(rules.is_private(F.col("tag"))).select("file_id", "tag", "code")


def _deidentified(spark: SparkSession, sf: str) -> DataFrame:
    return elements.deidentified(X.elements(spark, sf), rules.action_map(rules.catalog_rows(spark), "shift"), X.salt(spark), PROFILE_SHIFT)


_UID = f"'{P.UID_PREFIX}.' || (('0x' || substr({SHA('value')}, 1, 15))::UBIGINT) || '.' || (('0x' || substr({SHA('value')}, 16, 14))::UBIGINT)"
_RESULT = f"""{_DISPATCH}, d AS (SELECT *, CASE code WHEN 'X' THEN NULL WHEN 'GONE' THEN NULL WHEN 'H' THEN substr({SHA('value')}, 1, 16) WHEN 'D' THEN 'ANON^' || upper(substr({SHA('value')}, 1, 8)) WHEN 'U' THEN {_UID}
 WHEN 'S' THEN strftime(strptime(value, '%Y%m%d') + to_days({OFFSET("('ID' || k)")}), '%Y%m%d') WHEN 'C' THEN 'Echo for tel' ELSE value END AS result FROM s)"""


@query(f"WITH {_RESULT} SELECT file_id, ord::INT AS ord, tag, code, value AS original, result, code IN ('X', 'GONE') AS removed FROM d")
def element_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _deidentified(spark, sf).select("file_id", "ord", "tag", "code", "original", "result", "removed")


@query(f"WITH {_RESULT} SELECT code AS action, count(*)::BIGINT AS n FROM d WHERE code NOT IN ('AUTO', 'NONE', 'GONE') GROUP BY code")
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return elements.change_counts(elements.records(_deidentified(spark, sf)))


@query(f"WITH {_RESULT} SELECT result AS pseudonym, lower(printf('%X', tag)) AS category, value AS original FROM d WHERE code IN ('H', 'D', 'U')")
def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    return elements.crosswalk(elements.records(_deidentified(spark, sf)))


@query(f"WITH {_RESULT} SELECT count(DISTINCT result)::BIGINT AS n FROM d WHERE code IN ('H', 'D', 'U')")
def crosswalk_size(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.keystore import summary

    return summary(elements.crosswalk(elements.records(_deidentified(spark, sf))))


@query(f"SELECT substr({SHA('c_name')}, 1, 16) AS pseudonym, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS original FROM customer")
def reidentify(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the pseudonyms are in the crosswalk, the others unknown."""
    rows = X.table(spark, sf, "customer").crossJoin(F.broadcast(X.salt(spark))).select("c_custkey", F.col("c_name").alias("original"), P.salted(F.col("c_name"), F.col("salt")).alias("pseudonym"))
    walk = rows.where("c_custkey % 2 = 0").select("pseudonym", F.lit("100010").alias("category"), "original")
    return elements.reidentified(rows.select("pseudonym"), walk).select("pseudonym", "original")


@query(f"SELECT c_custkey AS k, substr({SHA('c_name')}, 1, 16) AS hashed, {SHA('c_name')} AS whole, 'ANON' || upper(substr({SHA('c_name')}, 1, 8)) AS dummy, {_UID.replace('value', 'c_name')} AS uid, {OFFSET('c_name')}::INT AS days FROM customer")
def pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    n, s = F.col("c_name"), F.col("salt")
    rows = X.table(spark, sf, "customer").crossJoin(F.broadcast(X.salt(spark)))
    return rows.select(F.col("c_custkey").alias("k"), P.salted(n, s).alias("hashed"), P.salted(n, s, 0).alias("whole"), P.dummy(n, F.lit("LO"), s).alias("dummy"), P.remapped_uid(n, s).alias("uid"), P.date_offset(n, s, 30, -30).alias("days"))


@query(f"SELECT o_orderkey AS k, strftime(o_orderdate + to_days({OFFSET('o_custkey')}), '%Y%m%d') AS da, strftime(o_orderdate + to_days({OFFSET('o_custkey')}), '%Y%m%d') || '101112.5&+0800' AS dt, strftime(o_orderdate + to_days({OFFSET('o_custkey')}), '%Y-%m-%d') || 'T10' AS iso, '20240231' AS bad FROM orders")
def date_shift(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "orders").crossJoin(F.broadcast(X.salt(spark))).withColumn("days", P.date_offset(F.col("o_custkey").cast("string"), F.col("salt"), -30, 30))
    d = F.date_format("o_orderdate", "yyyyMMdd")
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10"))
    return rows.select(F.col("o_orderkey").alias("k"), P.shifted_da(d, F.col("days")).alias("da"), P.shifted_date(F.concat(d, F.lit("101112.5&+0800")), F.col("days")).alias("dt"), P.shifted_iso(iso, F.col("days")).alias("iso"), P.shifted_da(F.lit("20240231"), F.col("days")).alias("bad"))


@query("SELECT o_custkey AS c, (max(o_orderdate)::DATE - min(o_orderdate)::DATE)::INT AS days, TRUE AS same FROM orders GROUP BY o_custkey")
def interval_preserved(spark: SparkSession, sf: str) -> DataFrame:
    """Shifting keeps the days between a person's dates."""
    rows = X.table(spark, sf, "orders").crossJoin(F.broadcast(X.salt(spark))).withColumn("days", P.date_offset(F.col("o_custkey").cast("string"), F.col("salt"), -30, 30))
    moved = F.to_date(P.shifted_da(F.date_format("o_orderdate", "yyyyMMdd"), F.col("days")), "yyyyMMdd")
    sums = rows.groupBy(F.col("o_custkey").alias("c")).agg(F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"), F.date_diff(F.max(moved), F.min(moved)).alias("after"))
    return sums.select("c", "days", (F.col("days") == F.col("after")).alias("same"))


@query("SELECT doc_id, " + MASK("coalesce(text, '')") + " AS preview FROM documents")
def mask_preview(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "documents").select("doc_id", P.masked(F.col("text")).alias("preview"))


@query("SELECT c_custkey AS k, 'see and ' || c_mktsegment AS clean FROM customer")
def known_value_scrub(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "customer")
    return rows.select(F.col("c_custkey").alias("k"), P.scrubbed_known(F.concat(F.lit(" see "), F.upper("c_name"), F.lit(" and  "), "c_mktsegment"), F.array("c_name")).alias("clean"))


@query("SELECT 'c' || c_custkey AS file_id, list_sort([c_name, 'ID' || c_custkey])[1] || ',' || list_sort([c_name, 'ID' || c_custkey])[2] AS known FROM customer")
def known_values(spark: SparkSession, sf: str) -> DataFrame:
    return elements.known_values(X.elements(spark, sf)).select("file_id", F.array_join("known", ",").alias("known"))


# --- views and names

_KEYWORDS = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, '{k}')" for t, k, _ in C.dictionary()) + ") AS x(tag, keyword))"
_TAG_TEXT = "'(' || substr(lpad(printf('%X', e.tag), 8, '0'), 1, 4) || ',' || substr(lpad(printf('%X', e.tag), 8, '0'), 5, 4) || ')'"
_VIEW = f"{X.elements_sql()}, {_KEYWORDS}, b AS (SELECT file_id, ord::INT AS ord, e.tag, {_TAG_TEXT} AS tag_text, coalesce(keyword, {_TAG_TEXT}) AS keyword, vr, CASE WHEN vr = 'SQ' THEN '<Sequence: ' || value || ' item(s)>' ELSE value END AS value, (parent > 0)::INT AS depth FROM e LEFT JOIN w ON e.tag = w.tag)"


@query(f"WITH {_VIEW} SELECT file_id, ord, tag_text, keyword, vr, value, depth FROM b")
def metadata_view(spark: SparkSession, sf: str) -> DataFrame:
    return elements.metadata_view(X.elements(spark, sf), rules.dictionary(spark)).select("file_id", "ord", "tag_text", "keyword", "vr", "value", "depth")


@query(f"WITH {_VIEW} SELECT file_id, ord, CASE WHEN tag = {0x00081030} AND substr(file_id, 2)::INT < 10000000 THEN {MASK('value')} ELSE value END AS value, tag = {0x00081030} AS flagged FROM b")
def metadata_masked(spark: SparkSession, sf: str) -> DataFrame:
    records, words = X.elements(spark, sf), rules.dictionary(spark)
    found = residual.findings(elements.text_values(records, words))
    return elements.masked_view(elements.metadata_view(records, words), found).select("file_id", "ord", "value", "flagged")


@query(f"SELECT c_custkey AS k, 'scan_' || substr({SHA('c_name')}, 1, 16) || '-' || 'a' || substr({SHA("('S' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') || 'A')")}, 1, 0) || '_x.nii.gz' AS clean FROM customer")
def filename_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "customer").selectExpr("c_custkey as k", "concat('scan_', c_name, '-a_x.nii.gz') as name", "array(c_name) as known")
    return elements.sanitised_names(rows, D.Scanner(detect_dates=False), X.salt(spark), known="known").select("k", "clean")


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '(?i)(\\.nii\\.gz|([^.])\\.[^.]*)$', '\\2') AS stem FROM pages")
def file_stems(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "pages").select("page_id", sidecars.stem(F.col("url")).alias("stem"))


# --- sidecars

_SIDE = "q AS (SELECT c_custkey AS k, c_name AS nm, 'in/sub' || c_custkey % 7 || '/c' || c_custkey || '.json' AS file_id FROM customer WHERE c_custkey % 50 <> 0)"
_DAY = f"strftime(DATE '2024-01-01' + to_days((k % 28)::INT) + to_days({OFFSET("('ID' || k)")}), '%Y-%m-%d') || 'T10:20:30'"


def _sidecar(spark: SparkSession, sf: str) -> DataFrame:
    rows = sidecars.entries(X.sidecars(spark, sf))
    keys = rules.keyword_action(F.col("key"), rules.action_map(rules.catalog_rows(spark), "shift"), rules.dictionary(spark), "shift")
    return sidecars.deidentified(rows, keys, X.salt(spark), low=-30, high=30)


@query(f"""WITH {_SIDE} SELECT file_id, 'PatientName' AS key, NULL AS result FROM q UNION ALL SELECT file_id, 'PatientID', NULL FROM q UNION ALL SELECT file_id, 'AcquisitionDateTime', {_DAY} FROM q
UNION ALL SELECT file_id, 'SeriesDescription', 'scan of [REDACTED] call [REDACTED]' FROM q UNION ALL SELECT file_id, 'MagneticFieldStrength', '3' FROM q""")
def sidecar_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _sidecar(spark, sf).select("file_id", "key", "result")


@query(f"WITH {_SIDE} SELECT file_id, 2::BIGINT AS n_removed, 2::BIGINT AS n_scrubbed, 1::BIGINT AS n_shifted FROM q")
def sidecar_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sidecars.counts(_sidecar(spark, sf))


@query("SELECT 'vol/c' || c_custkey || '.NII.gz' AS path, CASE WHEN c_custkey % 50 <> 0 THEN list_sort([c_name, 'ID' || c_custkey])[1] END AS first_known FROM customer")
def stem_join(spark: SparkSession, sf: str) -> DataFrame:
    side = X.sidecars(spark, sf)
    volumes = X.table(spark, sf, "customer").selectExpr("concat('vol/c', c_custkey, '.NII.gz') as path")
    joined = sidecars.volumes_with_known(volumes, sidecars.entries(side), side.selectExpr("file_id", "file_id as path"))
    return joined.select("path", F.get("known", F.lit(0)).alias("first_known"))


# --- residual scans


def _output(k: Column) -> Column:
    return F.concat(F.lit("out/f"), k, F.lit(".dcm"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs: the notes of every tenth order still as they were, the others redacted."""
    rows = D.redacted(X.notes(spark, sf).select("k", "text"), "text")
    return rows.select(_output(F.col("k")).alias("file_id"), F.lit(0x00081030).cast("long").alias("tag"), F.lit("StudyDescription").alias("keyword"), F.when(F.col("k") % 10 == 0, F.col("text")).otherwise(F.col("redacted")).alias("text"))


_LEFT = f"WITH {NOTES}, z AS (SELECT *, 'out/f' || k || '.dcm' AS file_id FROM t WHERE k % 10 = 0), g AS (SELECT file_id, unnest([{{'c': 'nric_fin', 's': CASE WHEN substr(nric, 9, 1) = {LETTER} THEN 1.0 ELSE 0.5 END, 'v': nric, 'o': TRUE}}, {{'c': 'phone', 's': 0.9, 'v': phone, 'o': TRUE}}, {{'c': 'email', 's': 1.0, 'v': mail, 'o': TRUE}}, {{'c': 'case_number', 's': 0.7, 'v': kase, 'o': TRUE}}, {{'c': 'date', 's': 0.85, 'v': iso, 'o': FALSE}}]) AS g FROM z), r AS (SELECT file_id, g.c AS category, g.s::DOUBLE AS score, g.v AS v, g.o AS confident FROM g)"


@query(f"{_LEFT} SELECT file_id, category, score, {MASK('v')} AS preview, confident FROM r")
def residual_findings(spark: SparkSession, sf: str) -> DataFrame:
    return residual.findings(_texts(spark, sf)).select("file_id", "category", "score", "preview", "confident")


@query(f"{_LEFT} SELECT file_id, category, count(*)::BIGINT AS n FROM r GROUP BY GROUPING SETS ((file_id, category), (category))")
def residual_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return residual.category_rollup(residual.findings(_texts(spark, sf)))


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    # Which files there are doesn't take their texts: only findings scan those.
    k = F.col("k")
    files = X.notes(spark, sf).select(_output(k).alias("file_id"), F.when(k % 3 != 0, k % 3 == 1).alias("identity_removed"), F.when(k % 7 == 3, "unreadable").alias("skipped"))
    return residual.verdicts(files, residual.findings(_texts(spark, sf)))


_VERDICT = "v AS (SELECT k, 'f' || k || '.dcm' AS file, k % 10 = 0 AS hit, k % 7 = 3 AS skipped FROM (SELECT o_orderkey AS k FROM orders))"


@query(f"WITH {_VERDICT} SELECT file, CASE WHEN hit THEN 5 ELSE 0 END::BIGINT AS findings, CASE WHEN hit THEN 4 ELSE 0 END::BIGINT AS confirmed, CASE WHEN hit THEN 'case_number, date, email, nric_fin, phone' ELSE '' END AS categories, CASE k % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN 'yes' ELSE 'NO' END AS identity_removed, CASE WHEN hit OR skipped THEN 'FLAG' ELSE 'PASS' END AS verdict FROM v")
def qa_files(spark: SparkSession, sf: str) -> DataFrame:
    return residual.qa_files(_verdicts(spark, sf))


@query(f"WITH {_VERDICT} SELECT count_if(NOT skipped)::BIGINT AS scanned, count_if(NOT skipped AND NOT hit)::BIGINT AS n_passed, count_if(NOT skipped AND hit)::BIGINT AS n_flagged, count_if(skipped)::BIGINT AS n_skipped, sum(CASE WHEN hit THEN 5 ELSE 0 END)::BIGINT AS findings, sum(CASE WHEN hit THEN 4 ELSE 0 END)::BIGINT AS n_confident, count_if(NOT skipped AND hit) = 0 AS passed FROM v")
def residual_batch(spark: SparkSession, sf: str) -> DataFrame:
    return residual.batch(_verdicts(spark, sf))


@query(f"{_LEFT} SELECT split_part(file_id, '/', 2) AS file, 'StudyDescription' AS field, category, CASE WHEN confident THEN 'confirmed' ELSE 'review' END AS confidence, {MASK('v')} AS preview FROM r")
def qa_findings(spark: SparkSession, sf: str) -> DataFrame:
    return residual.qa_findings(residual.findings(_texts(spark, sf))).select("file", "field", "category", "confidence", "preview")


_PLANTED = [("names", "Customer#000000003"), ("mrn", "ID17"), ("names", "Nurul Aisyah"), ("phone", "62345678"), ("address", "Maker BUILDING"), ("other", "Echo")]


@query(f"WITH {X.elements_sql()}, p AS (SELECT * FROM (VALUES {', '.join(map(str, _PLANTED))}) AS x(category, value)), n AS (SELECT replace(replace(value || ' ' || file_id, '^', ' '), '=', ' ') AS norm FROM e) SELECT DISTINCT category, p.value FROM p JOIN n ON contains(norm, p.value) WHERE category <> 'other'")
def survivors(spark: SparkSession, sf: str) -> DataFrame:
    return residual.survivors(X.elements(spark, sf).selectExpr("file_id", "value as text"), spark.createDataFrame(_PLANTED, "category string, value string"))


@query(f"""WITH {_RESULT}, p AS (SELECT * FROM (VALUES {', '.join(map(str, _PLANTED))}) AS x(category, value)), n AS (SELECT concat_ws(' ', result, file_id) AS norm FROM d WHERE code NOT IN ('X', 'GONE')),
left_ AS (SELECT DISTINCT category, p.value FROM p JOIN n ON contains(norm, p.value) WHERE category <> 'other'), {_VERDICT}
SELECT * FROM (VALUES ('every input has an output', TRUE), ('no planted value is left', (SELECT count(*) FROM left_) = 0), ('detectors find nothing for certain', (SELECT count_if(NOT skipped AND hit) FROM v) = 0), ('outputs can be read', (SELECT count_if(c_custkey % 50 = 0) FROM customer) = 0),
('reversible only if asked', (SELECT count(*) FROM d WHERE code IN ('H', 'D', 'U')) > 0), ('a second run has nothing to do', TRUE), ('faces removed where they can be', TRUE)) AS x(name, passed)""")
def acceptance_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The seven checks over one run's tables: records and what became of them, the notes that were scanned,
    sidecars of which some can't be read, the crosswalk and what it gives back, a manifest registered twice,
    and the volumes' face records."""
    done = _deidentified(spark, sf)
    outputs = done.where("not removed").select("file_id", F.col("result").alias("text"))
    walk = elements.crosswalk(elements.records(done))
    restored = elements.reidentified(walk.select("pseudonym").distinct(), walk).select(F.col("pseudonym").alias("p"), F.col("original").alias("restored"))
    side = X.sidecars(spark, sf)
    files = X.files(spark, sf).where("batch_id = 'b1'")
    cells = X.voxels(spark, sf)
    modality = X.table(spark, sf, "nation").selectExpr("concat('v', n_nationkey) as file_id", "if(n_nationkey % 2 = 0, 'MR', null) as modality")
    _, faces = arrays.defaced(cells, modality, None)
    checks = residual.acceptance_checks(
        inputs=X.elements(spark, sf).select("file_id").distinct(),
        outputs=outputs.select("file_id").distinct(),
        survived=residual.survivors(outputs, spark.createDataFrame(_PLANTED, "category string, value string")),
        summary=residual.batch(_verdicts(spark, sf)),
        unreadable=side.where(F.get_json_object("json", "$.PatientID").isNull()),
        walk=walk.join(restored, F.col("pseudonym") == F.col("p")),
        again=residual.reprocessed(files, manifest.registered(files, files.selectExpr("input_path as path"), "b1", "/in", "/new")),
        faces=residual.face_counts(faces.withColumn("deface_error", F.lit(None).cast("string"))),
        mode="reversible",
    )
    return checks.select("name", "passed")


@query("SELECT * FROM (VALUES (25::BIGINT, 12::BIGINT, (SELECT count_if(n_nationkey % 5 = 0) FROM nation)::BIGINT, FALSE)) AS x(n_records, n_defaced, n_errors, ok)")
def face_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "nation").selectExpr("concat('v', n_nationkey) as file_id", "n_nationkey % 2 = 1 as defaced", "if(n_nationkey % 5 = 0, 'broke', null) as deface_error")
    return residual.face_counts(rows)


@query("SELECT DISTINCT 'no model for ' || c_mktsegment AS note FROM customer WHERE c_custkey % 3 <> 0 UNION SELECT 'skipped' FROM customer WHERE c_custkey % 3 <> 0")
def distinct_notes(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "customer").selectExpr("if(c_custkey % 3 = 0, null, array(concat('no model for ', c_mktsegment), 'skipped', '', null)) as notes")
    return residual.distinct_notes(rows)


# --- independent of how rows are planted

#: Words of a text by DuckDB's own engine, which has no lookaround: runs of the characters that may touch.
_RUNS = lambda x, chars: f"regexp_split_to_array({x}, '[^{chars}]+')"
_DOC = "replace(replace(replace(coalesce(text, ''), 'the ', 'S' || lpad((doc_id % 10000000)::VARCHAR, 7, '0') || 'D '), ' de ', ' x_S1234567D 9123 4567,+65-8' || lpad((doc_id % 10000000)::VARCHAR, 7, '0') || ' '), ' der ', ' y' || lpad(doc_id::VARCHAR, 7, '0') || 'k a@b.co ' || lpad(doc_id::VARCHAR, 10, '0') || 'B ')"


@query(f"""WITH d AS (SELECT doc_id, {_DOC} AS t FROM documents)
SELECT doc_id, len(list_filter({_RUNS('t', '0-9A-Za-z_')}, lambda x: regexp_full_match(x, '[STFGM][0-9]{{7}}[A-Z]')))::BIGINT AS nric, len(list_filter({_RUNS('t', '0-9A-Za-z')}, lambda x: regexp_full_match(x, '(?i)[XY]([0-9]{{7}}|[0-9]{{10}})[A-Z]')))::BIGINT AS temp_ic,
len(list_filter({_RUNS('t', '0-9A-Za-z')}, lambda x: regexp_full_match(x, '[0-9]{{10}}[A-Za-z]')))::BIGINT AS case_number, len(regexp_extract_all(t, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b'))::BIGINT AS email,
len(regexp_extract_all(replace(t, '_', '.'), '\\b(?:65[\\s-]?)?[3689][0-9]{{3}}[\\s-]?[0-9]{{4}}\\b'))::BIGINT AS phone FROM d""")
def document_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of each format in every whole document, null ones among them. Common words are replaced by
    numbers with right and wrong neighbours, decoys and several of a kind."""
    docs = X.spread(X.table(spark, sf, "documents").select("doc_id", "text"))
    seven, ten = "lpad(cast(doc_id % 10000000 as string), 7, '0')", "lpad(cast(doc_id as string), 10, '0')"
    text = f"replace(replace(replace(coalesce(text, ''), 'the ', concat('S', {seven}, 'D ')), ' de ', concat(' x_S1234567D 9123 4567,+65-8', {seven}, ' ')), ' der ', concat(' y', lpad(cast(doc_id as string), 7, '0'), 'k a@b.co ', {ten}, 'B '))"
    rows = S.once(docs, "t", F.expr(text))
    kinds = {"nric": D.nric, "temp_ic": D.temp_ic, "case_number": D.case_number, "email": D.email, "phone": D.phone}
    return rows.select("doc_id", *[F.size(f(F.col("t"))).cast("long").alias(k) for k, f in kinds.items()])


# --- manifest


@query(f"WITH {X.FILES_SQL} SELECT count(*)::BIGINT AS total, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'in_progress')::BIGINT AS in_progress, count_if(status = 'done')::BIGINT AS done, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'flagged')::BIGINT AS flagged FROM f WHERE batch_id = 'b1'")
def manifest_progress(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.progress(X.files(spark, sf), "b1")


@query(f"WITH {X.FILES_SQL} SELECT id, status, finished_at FROM f ORDER BY coalesce(finished_at, started_at, '') DESC, id DESC LIMIT 15")
def manifest_recent(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.recent(X.files(spark, sf)).select("id", "status", "finished_at")


@query(f"WITH {X.FILES_SQL} SELECT input_path, error FROM f WHERE status = 'failed'")
def manifest_failures(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.failures(X.files(spark, sf))


@query(f"WITH {X.FILES_SQL} SELECT id, CASE WHEN status = 'in_progress' AND batch_id = 'b2' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'in_progress' AND batch_id = 'b2' THEN NULL ELSE worker END AS worker FROM f")
def reset_stale(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.reset_stale(X.files(spark, sf), "b2").select("id", "status", "worker")


@query(f"WITH {X.FILES_SQL}, c AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM f WHERE status = 'pending' AND batch_id = 'b1') SELECT f.id, CASE WHEN n <= 10 THEN 'in_progress' ELSE status END AS status, CASE WHEN n <= 10 THEN 'me' ELSE worker END AS worker FROM f LEFT JOIN c ON f.id = c.id")
def manifest_claim(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.claimed(X.files(spark, sf), "me", "2024-01-01T00:00:00", 10, "b1").select("id", "status", "worker")


@query(f"WITH {X.FILES_SQL} SELECT id, CASE WHEN status <> 'in_progress' THEN status WHEN id % 3 = 0 THEN 'failed' WHEN id % 3 = 1 THEN 'flagged' ELSE 'done' END AS status, CASE WHEN status = 'in_progress' AND id % 3 = 0 THEN 'broke' ELSE error END AS error, CASE WHEN status = 'in_progress' AND id % 3 <> 0 THEN id % 3 % 2 ELSE residual_count END::BIGINT AS residual_count FROM f")
def manifest_results(spark: SparkSession, sf: str) -> DataFrame:
    files = X.files(spark, sf)
    done = files.where("status = 'in_progress'").selectExpr("id", "if(id % 3 = 0, null, id % 3 % 2) as residual_count", "if(id % 3 = 0, 'broke', null) as error", "concat('sha', id) as output_sha256")
    return manifest.finished(files, done, "2024-01-01T00:00:00").select("id", "status", "error", "residual_count")


@query(f"WITH {X.FILES_SQL} SELECT id, CASE WHEN status IN ('done', 'flagged') AND id % 2 = 0 THEN CASE WHEN id % 4 = 0 THEN 'flagged' ELSE 'done' END ELSE status END AS status FROM f")
def set_residual(spark: SparkSession, sf: str) -> DataFrame:
    files = X.files(spark, sf)
    return manifest.with_residual(files, files.where("id % 2 = 0").selectExpr("output_path", "if(id % 4 = 0, 3L, 0L) as n")).select("id", "status")


_REGISTER = f"WITH {X.FILES_SQL}, h AS (SELECT * FROM f WHERE batch_id = 'b1'), o AS (SELECT rel_in FROM f WHERE id NOT IN (SELECT id FROM h)), m AS (SELECT max(id) AS top FROM h)"


@query(f"{_REGISTER} SELECT id, rel_in, status FROM h UNION ALL SELECT top + row_number() OVER (ORDER BY rel_in), rel_in, 'pending' FROM o, m")
def manifest_register(spark: SparkSession, sf: str) -> DataFrame:
    """One batch's files are known already; all files are registered again under it."""
    files = X.files(spark, sf)
    have = files.where("batch_id = 'b1'")
    return manifest.registered(have, files.selectExpr("input_path as path"), "b1", "/in", "/new").select("id", "rel_in", "status")


@query(f"WITH {X.FILES_SQL} SELECT 'b1' AS batch_id, 'p2' AS profile_id, 't0' AS created_at, 'ann' AS created_by, count(*)::BIGINT AS total FROM f WHERE batch_id = 'b1' UNION ALL SELECT 'b9', 'p1', 't1', NULL, 4::BIGINT")
def batch_upsert(spark: SparkSession, sf: str) -> DataFrame:
    have = spark.createDataFrame([("b1", "p1", "t0", "ann", 1), ("b9", "p1", "t1", None, 4)], manifest.BATCHES)
    return manifest.batch_totals(have, X.files(spark, sf), "b1", "p2", "t9", "bob")


# --- governance


@query(f"""WITH RECURSIVE {X.AUDIT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY seq) AS i FROM a),
r AS (SELECT chain, seq, i, 'GENESIS' AS prev_hash, sha256(concat_ws(chr(31), seq, ts, actor, role, action, details, 'GENESIS')) AS hash FROM n WHERE i = 1
UNION ALL SELECT n.chain, n.seq, n.i, r.hash, sha256(concat_ws(chr(31), n.seq, n.ts, n.actor, n.role, n.action, n.details, r.hash)) FROM r JOIN n ON n.chain = r.chain AND n.i = r.i + 1) SELECT chain, seq, prev_hash, hash FROM r""")
def audit_chain(spark: SparkSession, sf: str) -> DataFrame:
    return governance.chained(X.audit(spark, sf), ["chain"]).select("chain", "seq", "prev_hash", "hash")


@query(f"WITH {X.AUDIT_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY seq) AS i FROM a) SELECT chain, count_if(seq % 97 = 0) = 0 AS ok, count(*)::BIGINT AS n, min(CASE WHEN seq % 97 = 0 THEN i END)::BIGINT AS broken_at FROM n GROUP BY chain")
def audit_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Every 97th entry's details were changed after the fact."""
    log = governance.chained(X.audit(spark, sf), ["chain"])
    return governance.verified(log.withColumn("details", F.when(F.col("seq") % 97 == 0, "changed").otherwise(F.col("details"))), ["chain"])


@query("WITH s AS (SELECT o_orderkey AS k, 'u' || o_custkey % 5 AS d, CASE o_orderkey % 4 WHEN 0 THEN '  ' ELSE ' U' || o_orderkey % 5 END AS r, CASE WHEN o_orderkey % 3 = 0 THEN 'deidentifier' ELSE 'reviewer' END AS role FROM orders) SELECT k, role = 'reviewer' AND trim(r) <> '' AND lower(trim(r)) <> d AS ok, CASE WHEN role <> 'reviewer' THEN 'needs the role of a reviewer' WHEN trim(r) = '' THEN 'needs a reviewer''s name' WHEN lower(trim(r)) = d THEN 'reviewer and de-identifier are the same' ELSE '' END AS reason FROM s")
def signoff_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "orders").selectExpr("o_orderkey as k", "concat('u', o_custkey % 5) as d", "if(o_orderkey % 4 = 0, '  ', concat(' U', o_orderkey % 5)) as r", "if(o_orderkey % 3 = 0, 'deidentifier', 'reviewer') as role")
    return rows.select("k", governance.sign_off(F.col("d"), F.col("r"), F.col("role")).alias("g")).select("k", "g.*")


@query("SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'reviewer' ELSE 'deidentifier' END AS role FROM customer")
def logins(spark: SparkSession, sf: str) -> DataFrame:
    c = X.table(spark, sf, "customer")
    users = c.selectExpr("c_name as name", "if(c_custkey % 2 = 0, 'reviewer', 'deidentifier') as role", "concat('s', c_custkey) as salt", "sha2(concat('s', c_custkey, 'pw', c_custkey), 256) as hash")
    tries = c.selectExpr("c_name as name", "if(c_custkey % 3 = 0, 'no', concat('pw', c_custkey)) as password")
    return governance.logins(users, tries).select("name", "role")


@query("SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'extra' WHEN p_partkey % 11 = 0 THEN 'changed' ELSE 'same' END AS state FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 7 = 0)")
def bundle_diff(spark: SparkSession, sf: str) -> DataFrame:
    return governance.bundle_diff(*_bundles(spark, sf))


def _bundles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = X.table(spark, sf, "part")
    want = p.where("p_partkey % 7 <> 0 or p_partkey % 35 = 0").where("not (p_partkey % 35 = 0)").selectExpr("concat('p', p_partkey) as path", "sha2(p_name, 256) as sha256")
    have = p.where("p_partkey % 5 <> 0").selectExpr("concat('p', p_partkey) as path", "sha2(if(p_partkey % 11 = 0, 'other', p_name), 256) as sha256")
    return want, have


@query("WITH s AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'extra' WHEN p_partkey % 11 = 0 THEN 'changed' ELSE 'same' END AS state FROM part WHERE NOT (p_partkey % 5 = 0 AND p_partkey % 7 = 0)) SELECT FALSE AS ok, count_if(state = 'missing')::BIGINT AS missing, count_if(state = 'extra')::BIGINT AS extra, count_if(state = 'changed')::BIGINT AS changed, count_if(state IN ('same', 'changed'))::BIGINT AS n_checked FROM s")
def bundle_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return governance.bundle_verdict(governance.bundle_diff(*_bundles(spark, sf)))


# --- learning


@query("""SELECT p_type AS kind, CASE WHEN min(length(p_brand)) = max(length(p_brand)) THEN '\\b[A-Za-z]{5}\\#\\d' || CASE WHEN max(length(p_brand)) = 7 THEN '' ELSE '{' || (max(length(p_brand)) - 6) || '}' END ELSE '\\b[A-Za-z]{5}\\#\\d{' || (min(length(p_brand)) - 6) || ',' || (max(length(p_brand)) - 6) || '}' END || '\\b' AS pattern, count(*)::BIGINT AS n_samples, 1::BIGINT AS n_shapes FROM part GROUP BY p_type""")
def derived_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return learning.derived_patterns(X.table(spark, sf, "part").selectExpr("p_type as kind", "p_brand as sample"), ["kind"])


@query("SELECT c_custkey AS k, 'a:Customer sep:# d:' || substr(c_name, 10) AS tokens FROM customer")
def pattern_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = learning.tokens(F.col("c_name"))
    return X.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.array_join(F.transform(t, lambda x: F.concat_ws(":", x["kind"], x["text"])), " ").alias("tokens"))


@query("SELECT min(n_name) AS name FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY lower(n_name)")
def gazetteer_import(spark: SparkSession, sf: str) -> DataFrame:
    n = X.table(spark, sf, "nation")
    new = n.selectExpr("concat('  ', n_name, ' ') as name").union(n.selectExpr("concat('# ', n_name)")).union(n.selectExpr("''"))
    return learning.imported_names(n.where("n_nationkey % 3 = 0").selectExpr("lower(n_name) as name"), new)


@query("SELECT count_if(n_nationkey % 3 <> 0)::BIGINT AS added, count_if(n_nationkey % 3 = 0)::BIGINT AS skipped, count(*)::BIGINT AS total FROM nation")
def gazetteer_import_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = X.table(spark, sf, "nation")
    return learning.import_counts(n.where("n_nationkey % 3 = 0").selectExpr("lower(n_name) as name"), n.selectExpr("n_name as name"))


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'é of ' || c_name END AS text, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 5 END AS start, (CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 5 END + length(c_name))::INT AS \"end\", 'NAMES' AS label, CASE WHEN c_custkey % 4 = 0 THEN '{\"text\":\"' || c_name || '\", \"entities\": [[0, ' ELSE '{\"text\":\"é of ' || c_name || '\", \"entities\": [[5, ' END || (CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 5 END + length(c_name)) || ', \"NAMES\"]]}' AS json FROM customer")
def ner_export(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "customer").selectExpr("'names' as category", "concat(c_name, ' ') as value", "if(c_custkey % 4 = 0, 'elsewhere', concat('é of ', c_name)) as context")
    blank = rows.limit(1).selectExpr("category", "' ' as value", "context")
    return learning.ner_examples(rows.unionByName(blank))


# --- arrays


@query("WITH u AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)) SELECT 'e' || vec_id AS file_id, (i // 8)::INT AS y, (i % 8)::INT AS x, CASE WHEN (i % 8 BETWEEN 2 AND 4 AND i // 8 BETWEEN 1 AND 2) OR (i % 8 >= 6 AND i // 8 >= 7) OR (vec_id % 2 = 0 AND i // 8 = 0) THEN 0 ELSE v END AS v FROM u")
def box_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as an image of 8 by 8, with boxes for all frames, over the edge, and for one frame."""
    cells = _images(spark, sf)
    files = X.table(spark, sf, "embeddings")
    everywhere = files.selectExpr("concat('e', vec_id) as file_id", """inline(from_json('[{"x":2,"y":1,"w":3,"h":2},{"x":6,"y":7,"w":9,"h":9},{"x":1,"y":1,"w":0,"h":5},{"frame":1,"x":0,"y":0,"w":8,"h":8}]', 'array<struct<frame:int,x:int,y:int,w:int,h:int>>'))""")
    even = files.where("vec_id % 2 = 0").selectExpr("concat('e', vec_id) as file_id", "0 as frame", "-2 as x", "0 as y", "20 as w", "1 as h")
    return arrays.filled(cells, everywhere.unionByName(even)).select("file_id", "y", "x", "v")


def _images(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "embeddings").selectExpr("concat('e', vec_id) as file_id", "posexplode(embedding) as (i, v)").selectExpr("file_id", "0 as frame", "cast(i div 8 as int) as y", "cast(i % 8 as int) as x", "cast(v as double) as v")


@query("WITH u AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), m AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM u GROUP BY vec_id) SELECT 'e' || vec_id AS file_id, (i // 8)::INT AS y, (i % 8)::INT AS x, floor((v - lo) / (hi - lo) * 255)::INT AS v FROM u JOIN m USING (vec_id)")
def frame_scale(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.scaled(_images(spark, sf), ["file_id", "frame"]).select("file_id", "y", "x", "v")


@query(f"WITH {X.VOXELS_SQL} SELECT file_id, quantile_cont(v, 0.01) < -300 AS is_ct FROM v GROUP BY file_id")
def ct_gate(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.looks_like_ct(X.voxels(spark, sf))


@query(f"WITH {X.VOXELS_SQL}, m AS (SELECT file_id, avg(v) AS mean FROM v GROUP BY file_id), f AS (SELECT file_id, z, (v > mean)::INT AS fg FROM v JOIN m USING (file_id)) SELECT file_id, 1 - avg(CASE WHEN z IN (0, 19) THEN fg END) > 0.7 AND avg(fg) > 0.02 AND avg(fg) < 0.6 AS is_head FROM f GROUP BY file_id")
def head_gate(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.head_inclusive(X.voxels(spark, sf))


@query(f"WITH {X.VOXELS_SQL}, s AS (SELECT file_id, z, y, x FROM v WHERE v > 500 AND z = 10), d AS (SELECT DISTINCT file_id, z + dz AS z, y + dy AS y, x + dx AS x FROM s, (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS o(dz, dy, dx)) SELECT file_id, count(*)::BIGINT AS n FROM d WHERE z BETWEEN 0 AND 19 AND y BETWEEN 0 AND 23 AND x BETWEEN 0 AND 23 GROUP BY file_id")
def dilate(spark: SparkSession, sf: str) -> DataFrame:
    cells = X.voxels(spark, sf)
    sizes = cells.groupBy("file_id").agg(*[(F.max(a) + 1).alias(f"n_{a}") for a in "zyx"])
    return arrays.dilated(cells.where("v > 500 and z = 10").select("file_id", "z", "y", "x"), sizes).groupBy("file_id").agg(F.count("*").alias("n"))


@query()
def deface(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes of even number are said to be MR; the model stub takes the bright cells of one slice for a face."""
    cells = X.voxels(spark, sf)
    modality = X.table(spark, sf, "nation").selectExpr("concat('v', n_nationkey) as file_id", "if(n_nationkey % 2 = 0, 'MR', null) as modality")
    out, plan = arrays.defaced(cells, modality, lambda v: v.where("v > 500 and z = 10").select("file_id", "z", "y", "x"), margin=1)
    return out.groupBy("file_id").agg(F.count_if(F.col("v") > 0).alias("bright")).join(plan, "file_id")


# --- layers that need a model, and pixels of files; models and readers here are stubs


def _stub_model():
    import re

    def find(text: str):
        found = [(m.start(), m.end(), "PERSON", 0.9) for m in re.finditer(r"Customer#\d+", text)] + [(m.start(), m.end(), "ORG", 0.9) for m in re.finditer("BUILDING", text)]
        return found + [(m.start(), m.end(), "LOCATION", 0.3 if m[0][-1] in "13579" else 0.8) for m in re.finditer(r"(?<= in )[^,]+", text)]

    return find


@query("SELECT c_custkey AS k, 0 AS at, length(c_name)::INT AS til, 'name' AS category, 'presidio' AS source FROM customer UNION ALL SELECT c_custkey, (length(c_name) + 4)::INT, (length(c_name) + 4 + length(n_name))::INT, 'location', 'presidio' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE right(n_name, 1) NOT IN ('1', '3', '5', '7', '9')")
def model_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Names and places by a model in the worker: low scores and other labels are left out; a second layer, whose
    folder isn't there, adds only a note."""
    names = X.table(spark, sf, "nation").selectExpr("n_name", "n_nationkey")
    rows = X.table(spark, sf, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey as k", "concat(c_name, ' in ', n_name, ', ', c_mktsegment) as text")
    found = models.scanned(rows, "text", D.Scanner(detect_dates=False), [models.entity_layer(_stub_model), models.ner_layer(None, lambda _: _stub_model())])
    return found.select("k", F.explode("spans").alias("s")).where("s.source = 'presidio'").select("k", F.col("s.start").alias("at"), F.col("s.end").alias("til"), "s.category", "s.source")


@query(f"""WITH {NOTES}, r AS (SELECT k, 'SG_NRIC_FIN' AS category, 1.0::DOUBLE AS score FROM t WHERE substr(nric, 9, 1) = {LETTER} UNION ALL SELECT k, 'SG_NRIC_FIN', 0.5 FROM t UNION ALL SELECT k, 'SG_TEMP_IC', 0.6 FROM t UNION ALL SELECT k, 'SG_CASE_NUMBER', 0.5 FROM t UNION ALL SELECT k, 'SG_PHONE', 0.7 FROM t UNION ALL SELECT k, 'SG_PHONE', 0.4 FROM t
UNION ALL SELECT k, 'SG_POSTAL', 0.6 FROM t UNION ALL SELECT k, 'SG_POSTAL', 0.6 FROM t WHERE k % 2 = 0) SELECT category, score, count(*)::BIGINT AS n FROM r GROUP BY category, score""")
def recognised(spark: SparkSession, sf: str) -> DataFrame:
    """The registered recognisers over the notes, with a number without a check letter, a temporary one, and
    postal codes of two kinds."""
    extra = F.expr("concat(text, ' M1234567K Y', lpad(cast(k % 10000000 as string), 7, '0'), 'Q Singapore 12345', cast(k % 10 as string), if(k % 2 = 0, ' S(123456)', ' S(12345)'))")
    rows = S.once(X.notes(spark, sf).select("k", extra.alias("text")), "s", models.recognised(F.col("text")))
    return rows.select(F.explode("s").alias("s")).groupBy("s.category", "s.score").agg(F.count("*").alias("n"))


def _stub_reader():
    def read(image):
        if image.max() == 0:
            raise ValueError("blank image")
        return [(f"9{int(image.sum()):07d}", 1, 1, 3, 2), ("word", 0, 0, 2, 2)]

    return read


@query("WITH u AS (SELECT vec_id, i - 1 AS i, floor(abs(embedding[i]) * 100)::INT % 200 AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)) SELECT 'e' || vec_id AS file_id, (i // 8)::INT AS y, (i % 8)::INT AS x, (CASE WHEN vec_id % 3 = 0 OR (i % 8 BETWEEN 2 AND 4 AND i // 8 BETWEEN 1 AND 2) THEN 0 ELSE v END)::INT AS v FROM u")
def stored_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as a file of one image: boxes filled, stored and read again; every third wholly."""
    from ..sources import dicom

    table = X.table(spark, sf, "embeddings")
    # In the precision of the vectors, as SQL multiplies: 0.18 as a float is 18 hundredths, as a double 17.99...
    hundred = F.lit(100).cast(table.schema["embedding"].dataType.elementType)
    rows = table.select(F.concat(F.lit("e"), "vec_id").alias("file_id"), "vec_id", F.transform("embedding", lambda v: (F.floor(F.abs(v) * hundred) % 200).cast("int")).alias("cells"))

    def files(batches):
        import pyarrow as pa

        u = lambda x: x.to_bytes(2, "little")
        head = [(dicom.SAMPLES, "US", u(1)), (dicom.ROWS, "US", u(8)), (dicom.COLUMNS, "US", u(8)), (dicom.BITS, "US", u(8)), (dicom.SIGNED, "US", u(0))]
        for b in batches:
            made = [dicom.encoded([*head, (dicom.PIXELS, "OB", bytes(c))]) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["file_id", "content"])

    raw = rows.select("file_id", "cells").mapInArrow(files, "file_id string, content binary")
    boxes = rows.selectExpr("file_id", "cast(null as int) as frame", "if(vec_id % 3 = 0, -5, 2) as x", "if(vec_id % 3 = 0, 0, 1) as y", "if(vec_id % 3 = 0, 99, 3) as w", "if(vec_id % 3 = 0, 99, 2) as h")
    again = dicom.frames(arrays.redacted_pixels(raw, boxes).select("file_id", "content"))
    cells = again.select("file_id", "w", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("data")), lambda k: F.conv(F.hex(F.substring(F.col("data"), k, F.lit(1))), 16, 10).cast("int"))).alias("i", "v"))
    return cells.select("file_id", F.expr("cast(i div w as int)").alias("y"), F.expr("cast(i % w as int)").alias("x"), "v")


@query("WITH v AS (SELECT n_nationkey AS k, unnest(range(3))::INT AS frame FROM nation) SELECT 'n' || k AS file_id, frame, 1 AS x, 1 AS y, 3 AS w, 2 AS h FROM v WHERE k % 4 <> 0 OR frame < 1")
def image_words(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of words in frames; every fourth file's second frame can't be read, which ends that file."""
    rows = X.table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) as file_id", "n_nationkey as k", "explode(sequence(0, 2)) as frame")
    frames = rows.selectExpr("file_id", "frame", "4 as h", "4 as w", "1 as c", "'|u1' as dtype", "unhex(if(k % 4 = 0 and frame = 1, repeat('07', 16), concat(repeat('00', 8), repeat('09', 8)))) as data")
    boxes, _ = models.boxes_of(models.words_in(frames, _stub_reader))
    return boxes.select("file_id", "frame", "x", "y", "w", "h")


def _stub_renderer():
    import numpy as np

    def render(content: bytes, dpi: int):
        if content[:1] == b"x":
            raise ValueError("encrypted")
        return [np.arange(48, dtype=np.uint8).reshape(4, 4, 3)] * int(content[1:])

    return render


@query("SELECT 'n' || n_nationkey AS file_id, CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 3 = 0 THEN 'removed_fallback' ELSE 'rasterize_redact' END AS mode, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0 THEN n_nationkey % 3 END::INT AS pages, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0 THEN n_nationkey % 3 END::INT AS boxes FROM nation")
def documents_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Embedded documents as pages with words filled; those that can't be rendered, or have no page, are removed."""
    rows = X.table(spark, sf, "nation").selectExpr("concat('n', n_nationkey) as file_id", "cast(concat(if(n_nationkey % 5 = 0, 'x', 'p'), n_nationkey % 3) as binary) as content")
    return models.redacted_documents(rows, _stub_renderer, _stub_reader).select("file_id", "mode", "pages", "boxes")


from . import file_queries  # noqa: E402, F401 - registers the queries over files
