"""Values that come out apart in single and in double precision."""

import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry


@pytest.mark.parametrize("kind", [T.FloatType(), T.DoubleType()])
def test_stored_pixels_against_sql(spark, tmp_path, kind):
    """0.18 is 18 hundredths as a float and 17.99... as a double; SQL keeps the vectors' own precision."""
    duckdb = pytest.importorskip("duckdb")
    vectors = [(k, [0.17999999225139618, -0.29, 0.57, 1.13, *[0.01 * (k + i) for i in range(60)]]) for k in range(1, 5)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind))])
    spark.createDataFrame(vectors, schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["stored_pixels"]).fetchall()
    got = entry.queries()["stored_pixels"](spark, str(tmp_path)).select("file_id", "y", "x", "v").collect()
    assert sorted(map(tuple, got)) == sorted(want)
