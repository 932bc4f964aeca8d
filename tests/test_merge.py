"""Merged spans of whole notes: all clusters, not the first alone."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veildeck.plans import planted

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["merge_overlaps", "merge_overlaps_all"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{SF}/orders.parquet')")
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, rel.fetchall()))


def test_all_clusters_of_a_note(spark):
    notes = planted.notes(spark, SF).select("k", "text")
    found = entry.queries()["merge_overlaps_all"](spark, SF).join(notes, "k")
    rows = found.orderBy("k", "at").limit(5).select("category", F.expr("substring(text, cast(at as int) + 1, cast(til - at as int))").alias("x")).collect()
    assert [r.category for r in rows] == ["custom", "phone", "email", "custom", "date"]
    assert rows[0].x.endswith(" call") and rows[1].x.startswith("+65 9") and rows[2].x.endswith("@example.sg") and rows[3].x.startswith("case ")


def test_whole_note_is_scanned(spark, monkeypatch):
    """An identifier after character 20 that the phrase precedes is still found where the head has none."""
    late = spark.createDataFrame([(1, "x" * 30 + " S1234567D call")], "k long, text string")
    monkeypatch.setattr(planted, "notes", lambda *_: late)
    (row,) = entry.queries()["merge_overlaps"](spark, SF).collect()
    assert (row["at"], row["til"], row["category"]) == (31, 45, "custom")
