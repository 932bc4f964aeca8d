"""The driver's contract, and a few queries against their SQL twins."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


def test_entry(spark):
    assert {r.category for r in entry.entry(spark).collect()} == {"nric_fin", "phone", "email", "case_number", "date"}


@pytest.mark.parametrize("name", ["nric_score", "action_map", "element_dispatch", "audit_verify", "bundle_diff", "manifest_progress", "date_shift", "head_gate"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall()), key=repr)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr) == want
