"""Many small files: batches shared by them, and a folder read as Spark's own reader reads it."""

import pyarrow as pa

from veildeck.sources import dicom, files


def test_small_records_share_a_batch(spark):
    raw = dicom.encoded([(0x00100010, "PN", "Tan^Wei"), (0x00101002, "SQ", [[(0x00100020, "LO", "X")]])])
    df = spark.createDataFrame([(f"f{k}", raw if k % 5 else b"broken") for k in range(300)], "file_id string, content binary").coalesce(1)

    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows for b in batches], pa.int64())], ["n"])

    got = [r.n for r in dicom.elements(df).mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 240 * 3 + 60 and len(got) < 10
    rows = dicom.elements(df).select("file_id", "tag", "value", "skipped").collect()
    assert {r.file_id for r in rows if r.skipped is not None} == {f"f{k}" for k in range(0, 300, 5)}
    assert [r.value for r in rows if r.file_id == "f1"] == ["Tan^Wei", "1", "X"]


def test_sidecars_as_sparks_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILES_A_TASK", 3)
    for k in range(20):
        (tmp_path / f"a{k % 3}" / "in b").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"a{k % 3}" / "in b" / f"c{k}.json").write_text('{"k": %d}' % k)
    for name, text in [("a0/x%y [1]#é.JSON", "é"), ("a1/empty.json", ""), ("_hid.json", "1"), (".hid.json", "1"), ("_k=1.json", "2"), ("note.txt", "1"), ("jsonx", "1")]:
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "_not").mkdir()
    (tmp_path / "_not" / "c.json").write_text("1")
    want = sorted(map(tuple, files._read_sidecars(spark, f"file://{tmp_path}").collect()))
    got = files.sidecars(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 22  # without the empty one
    assert got.rdd.getNumPartitions() >= 7
