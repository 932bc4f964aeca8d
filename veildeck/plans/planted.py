"""Inputs of the registered queries: identifiers planted by rule into the driver's tables.

The same rules are written out in the SQL twins, so that both sides start from equal values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALT = "pepper"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of keys from which texts are made by rule, for one task: some 100,000 rows.
PER_TASK = 1 << 20


def spread(df: DataFrame, per_task: int | None = None) -> DataFrame:
    """Rows of a table in fewer partitions than cores, as a small file gives, dealt out: scans of texts cost
    far more than moving them. A large table stays as it is, unless a task may have only so many bytes (as the
    plan estimates them): short keys that become long texts are dealt to more tasks than the file has splits."""
    least = df.sparkSession.sparkContext.defaultParallelism
    if per_task:
        least = max(least, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // per_task))
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def salt(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(SALT,)], "salt string")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and text of every order: a number with a check letter, right or wrong, a phone, a mail address, a
    case number and a date."""
    o = spread(table(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_orderdate d"), PER_TASK)
    n7 = "lpad(cast(k % 10000000 as string), 7, '0')"
    return o.selectExpr(
        "k", "d",
        f"concat('Seen S', {n7}, chr(cast(65 + k % 26 as int)), ' call +65 9', substr({n7}, 1, 3), ' ', substr({n7}, 4, 4), ' mail u', cast(k as string), '@example.sg, case ', lpad(cast(k % 10000000000 as string), 10, '0'), 'B on ', date_format(d, 'yyyy-MM-dd'), '.') as text",
    )


#: The same in DuckDB.
NOTES_SQL = """n AS (SELECT o_orderkey AS k, o_orderdate AS d, lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') AS n7, lpad((o_orderkey % 10000000000)::VARCHAR, 10, '0') AS n10, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders),
p AS (SELECT k, d, 'S' || n7 || chr((65 + k % 26)::INT) AS nric, '+65 9' || substr(n7, 1, 3) || ' ' || substr(n7, 4, 4) AS phone, 'u' || k || '@example.sg' AS mail, n10 || 'B' AS kase, iso FROM n),
t AS (SELECT k, d, nric, phone, mail, kase, iso, 'Seen ' || nric || ' call ' || phone || ' mail ' || mail || ', case ' || kase || ' on ' || iso || '.' AS text FROM p)"""

#: The check letter of t.nric in DuckDB, by arithmetic on its digits.
LETTER_SQL = "substr('JZIHGFEDCBA', ((substr(nric, 2, 1)::INT * 2 + substr(nric, 3, 1)::INT * 7 + substr(nric, 4, 1)::INT * 6 + substr(nric, 5, 1)::INT * 5 + substr(nric, 6, 1)::INT * 4 + substr(nric, 7, 1)::INT * 3 + substr(nric, 8, 1)::INT * 2) % 11 + 1)::INT, 1)"

#: tag, vr, value, parent sequence (0: none) of each element of a customer's record.
ELEMENTS = [
    (0x00100010, "PN", "c_name", 0),
    (0x00100020, "LO", "'ID' || c_custkey", 0),
    (0x00080020, "DA", "'2024' || lpad(cast(c_custkey % 12 + 1 as string), 2, '0') || lpad(cast(c_custkey % 28 + 1 as string), 2, '0')", 0),
    (0x00080018, "UI", "'1.2.3.' || c_custkey", 0),
    (0x00081030, "LO", "'Echo for  ' || c_name || ' tel 9' || lpad(cast(c_custkey % 10000000 as string), 7, '0')", 0),
    (0x00204000, "LT", "'comment ' || c_custkey", 0),
    (0x00091001, "LO", "c_mktsegment", 0),
    (0x00080070, "LO", "'Maker ' || c_mktsegment", 0),
    (0x00200011, "IS", "'5'", 0),
    (0x00101002, "SQ", "'1'", 0),
    (0x00100020, "LO", "'ALT' || c_custkey", 0x00101002),
    (0x54000100, "SQ", "'1'", 0),
    (0x003A0010, "LO", "'voice of ' || c_name", 0x54000100),
]


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all customers in long form."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), PER_TASK)
    path = lambda p: f"array(named_struct('tag', {p}L, 'item', 0))" if p else "cast(array() as array<struct<tag:bigint,item:int>>)"
    rows = ", ".join(f"named_struct('path', {path(p)}, 'ord', {k}, 'tag', {t}L, 'vr', '{vr}', 'value', {v})" for k, (t, vr, v, p) in enumerate(ELEMENTS))
    long = c.selectExpr("concat('c', c_custkey) as file_id", f"explode(array({rows})) as e").select("file_id", "e.*")
    return long.withColumn("values", F.array().cast("array<string>")).withColumn("value_bin", F.lit(None).cast("binary")).select("file_id", "path", "ord", "tag", "vr", "value", "values", "value_bin")


def elements_sql() -> str:
    """e (file_id, ord, tag, vr, value, parent) in DuckDB."""
    parts = " UNION ALL ".join(f"SELECT 'c' || c_custkey AS file_id, {k} AS ord, {t}::BIGINT AS tag, '{vr}' AS vr, {v} AS value, {p}::BIGINT AS parent, c_custkey AS k, c_name AS nm FROM customer" for k, (t, vr, v, p) in enumerate(ELEMENTS))
    return f"e AS ({parts})"


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, json of every supplier and customer: one in fifty isn't valid JSON."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), PER_TASK)
    text = """concat('{"PatientName": "', c_name, '", "PatientID": "ID', c_custkey, '", "AcquisitionDateTime": "2024-01-', lpad(cast(c_custkey % 28 + 1 as string), 2, '0'), 'T10:20:30", "SeriesDescription": "scan of ', c_name, ' call 91234567", "MagneticFieldStrength": 3}')"""
    return c.selectExpr("concat('in/sub', c_custkey % 7, '/c', c_custkey, '.json') as file_id", f"if(c_custkey % 50 = 0, '{{broken', {text}) as json", "c_custkey k", "c_name nm")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest row for each order, its state from the order."""
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(
        "o_orderkey as id", "concat('b', o_custkey % 5) as batch_id", "concat('d', o_orderkey % 10, '/f', o_orderkey, '.dcm') as rel_in", "concat('d', o_orderkey % 10, '/f', o_orderkey, '.dcm') as rel_out",
        "concat('/in/d', o_orderkey % 10, '/f', o_orderkey, '.dcm') as input_path", "concat('/out/d', o_orderkey % 10, '/f', o_orderkey, '.dcm') as output_path",
        "element_at(array('pending', 'in_progress', 'done', 'failed', 'flagged'), cast(o_orderkey % 5 + 1 as int)) as status", "if(o_orderkey % 5 = 0, null, concat('w', o_orderkey % 3)) as worker",
        "if(o_orderkey % 5 = 0, null, date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")) as started_at", "if(o_orderkey % 5 < 2, null, date_format(o_orderdate + interval 1 day, \"yyyy-MM-dd'T'HH:mm:ss\")) as finished_at",
        "if(o_orderkey % 5 = 4, 2L, null) as residual_count", "cast(null as string) as modality", "cast(null as string) as transfer_syntax", "cast(null as string) as input_sha256", "cast(null as string) as output_sha256", "if(o_orderkey % 5 = 3, concat('error ', o_orderkey), null) as error",
    )


FILES_SQL = """f AS (SELECT o_orderkey AS id, 'b' || o_custkey % 5 AS batch_id, 'd' || o_orderkey % 10 || '/f' || o_orderkey || '.dcm' AS rel_in, '/in/d' || o_orderkey % 10 || '/f' || o_orderkey || '.dcm' AS input_path, '/out/d' || o_orderkey % 10 || '/f' || o_orderkey || '.dcm' AS output_path,
['pending', 'in_progress', 'done', 'failed', 'flagged'][o_orderkey % 5 + 1] AS status, CASE WHEN o_orderkey % 5 <> 0 THEN 'w' || o_orderkey % 3 END AS worker, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS started_at,
CASE WHEN o_orderkey % 5 >= 2 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') END AS finished_at, CASE WHEN o_orderkey % 5 = 4 THEN 2::BIGINT END AS residual_count, CASE WHEN o_orderkey % 5 = 3 THEN 'error ' || o_orderkey END AS error FROM orders)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, seq, ts, actor, role, action, details of every event: a chain for each user."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr("user_id as chain", "event_id as seq", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") as ts", "concat('u', user_id) as actor", "if(event_id % 2 = 0, 'reviewer', 'deidentifier') as role", "event_type as action", "props as details")


AUDIT_SQL = "a AS (SELECT user_id AS chain, event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, 'u' || user_id AS actor, CASE WHEN event_id % 2 = 0 THEN 'reviewer' ELSE 'deidentifier' END AS role, event_type AS action, props AS details FROM events)"


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume of 20 x 24 x 24 for each nation: a ball over air, whose values the key shifts."""
    n = table(spark, sf_dir, "nation").selectExpr("concat('v', n_nationkey) as file_id", "n_nationkey k", "explode(sequence(0, 20 * 24 * 24 - 1)) id")
    cells = n.selectExpr("file_id", "k", "cast(id div 576 as int) z", "cast(id div 24 % 24 as int) y", "cast(id % 24 as int) x")
    inside = "(z - 10) * (z - 10) + (y - 12) * (y - 12) + (x - 12) * (x - 12) < 36 + k"
    return cells.selectExpr("file_id", "z", "y", "x", f"cast(case when {inside} then 500 + k else case when k % 3 = 0 then -900 else 0 end end as double) as v")


VOXELS_SQL = """v AS (SELECT 'v' || n_nationkey AS file_id, n_nationkey AS k, z, y, x, (CASE WHEN (z - 10) * (z - 10) + (y - 12) * (y - 12) + (x - 12) * (x - 12) < 36 + n_nationkey THEN 500 + n_nationkey WHEN n_nationkey % 3 = 0 THEN -900 ELSE 0 END)::DOUBLE AS v
FROM nation, (SELECT (i // 576)::INT AS z, (i // 24 % 24)::INT AS y, (i % 24)::INT AS x FROM range(20 * 24 * 24) r(i)))"""
