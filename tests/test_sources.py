"""Sources and streams over files made here."""

import numpy as np
from pyspark.sql import functions as F

from veildeck.sources import dicom, files, volumes
from veildeck.streaming import batches


def test_dicom_elements(spark, tmp_path):
    rows = [(0x00100010, "PN", "Tan^Wei"), (0x00100020, "LO", "A\\B"), (0x00280010, "US", b"\x04\x00"), (0x0020000D, "UI", "1.2.3"), (0x00101002, "SQ", [[(0x00100020, "LO", "X")], [(0x00100020, "LO", "Y")]]), (0x7FE00010, "OW", b"\x01\x02\x03\x04")]
    (tmp_path / "a.dcm").write_bytes(dicom.encoded(rows))
    (tmp_path / "bad.dcm").write_bytes(b"nothing")
    dicom.register(spark)
    got = spark.read.format("dicom_elements").load(str(tmp_path))
    by = {(r.tag, tuple((p.tag, p.item) for p in r.path)): r for r in got.where("skipped is null").collect()}
    assert by[0x00100010, ()].value == "Tan^Wei" and by[0x00100020, ()]["values"] == ["A", "B"] and by[0x00280010, ()].value == "4"
    assert by[0x00101002, ()].value == "2" and by[0x00100020, ((0x00101002, 1),)].value == "Y" and bytes(by[0x7FE00010, ()].value_bin) == b"\x01\x02\x03\x04"
    assert got.where("skipped is not null").count() == 1
    again = dicom.elements(files.tree(spark, str(tmp_path), content=True).select(F.col("path").alias("file_id"), "content"))
    assert again.count() == got.count()


def test_nifti(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    for name, v, z in [("a.nii.gz", 1, True), ("b.nii", 2, False)]:
        (tmp_path / name).write_bytes(volumes.made(a, "for Tan", v, z))
    (tmp_path / "c.nii").write_bytes(b"\0" * 400)
    raw = files.tree(spark, str(tmp_path), content=True).select(F.col("rel").alias("file_id"), "content")
    head = {r.file_id: r for r in volumes.headers(raw).collect()}
    assert head["a.nii.gz"].descrip == "for Tan" and head["b.nii"].version == 2 and head["b.nii"].shape == [2, 3, 4] and head["c.nii"].error
    clean = {r.file_id: r.content for r in volumes.cleaned(raw).where("error is null").collect()}
    for content in clean.values():
        v = volumes.Volume(bytes(content))
        assert v.text("descrip") == "" and (v.array() == a).all()
    assert [r[0] for r in spark.createDataFrame([("x.NII.gz",), ("x.nii",), ("x.niix",)], "p string").select(volumes.is_nifti(F.col("p"))).collect()] == [True, True, False]


def test_name_tables(spark, tmp_path):
    (tmp_path / "n.csv").write_text("Name;;Name\nTan;1;x\n# no;2;y\n Tan ;3;z\nLim;4;w\n")
    assert sorted(r.name for r in files.name_table(spark, str(tmp_path / "n.csv")).collect()) == ["Lim", "Tan"]
    assert files.unique_names(["a", "", "a"]) == ["a", "Column 2", "a.1"]
    (tmp_path / "one.txt").write_text("\nTan\nLim\n")
    assert files.name_table(spark, str(tmp_path / "one.txt"), header=False).count() == 2


def test_json_logs_skip_broken_lines(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"rel_in": "a", "status": "done"}\nbroken\n{"rel_in": "b", "error": "x"}\n')
    rows = {r.rel_in: (r.status, r.error) for r in files.processing_log(spark, str(tmp_path / "p.jsonl")).collect() if r.rel_in}
    assert rows == {"a": ("done", None), "b": (None, "x")}


def test_stream_resumes_without_repeats(spark, tmp_path):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    (root / "sub").mkdir(parents=True)
    work = lambda df: df.select("rel_in", F.when(F.length("content") > 1, "done").otherwise("failed").alias("status"), F.when(F.length("content") < 2, "short").alias("error"))
    (root / "a.dcm").write_bytes(b"xx")
    (root / "sub" / "b.dcm").write_bytes(b"x")
    batches.drained(spark, str(root), out, state, work, "b1").awaitTermination()
    (root / "c.dcm").write_bytes(b"yy")
    batches.drained(spark, str(root), out, state, work, "b1").awaitTermination()
    batches.drained(spark, str(root), out, str(tmp_path / "other"), work, "b1").awaitTermination()  # a lost checkpoint
    rows = sorted((r.rel_in, r.status) for r in spark.read.parquet(out).collect())
    assert rows == [("a.dcm", "done"), ("c.dcm", "done"), ("sub/b.dcm", "failed")]
    assert batches.watched_progress(spark, out).where("status = 'done'").first().n == 2
