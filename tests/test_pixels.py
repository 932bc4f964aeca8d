"""Files of all transfer syntaxes that are read, frames, stored frames, rewritten records."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veildeck.operators import arrays
from veildeck.plans import corpus
from veildeck.sources import dicom

ROWS = [(0x00080018, "UI", "1.2.3.9"), (0x00100010, "PN", "Tan^Wei"), (0x00100020, "LO", "A\\B"), (0x00280010, "US", b"\x04\x00"), (0x00189087, "FD", struct.pack("<d", 1.5)), (0x00101002, "SQ", [[(0x00100020, "LO", "X")], [(0x00100020, "LO", "Y")]])]


def in_syntax(nodes, syntax):
    """The same record in another syntax, written out by hand."""
    big = syntax == dicom.BIG_ENDIAN
    o = ">" if big else "<"

    def element(tag, vr, value):
        if isinstance(value, list):
            value = b"".join(struct.pack(f"{o}HHI", 0xFFFE, 0xE000, len(x)) + x for x in (body(i) for i in value))
        else:
            value = value.encode() if isinstance(value, str) else value
            value = dicom._swapped(vr, value) if big else value
            value += (b"\0" if vr == "UI" else b" ") * (len(value) % 2)
        head = struct.pack(f"{o}HH", tag >> 16, tag & 0xFFFF)
        if syntax == dicom.IMPLICIT:
            return head + struct.pack("<I", len(value)) + value
        return head + vr.encode() + (struct.pack(f"{o}HI", 0, len(value)) if vr in dicom.LONG_VRS else struct.pack(f"{o}H", len(value))) + value

    def body(nodes):
        return b"".join(element(*n) for n in sorted(nodes, key=lambda n: n[0]))

    data = body(nodes)
    if syntax == dicom.DEFLATED:
        z = zlib.compressobj(wbits=-15)
        data = z.compress(data) + z.flush()
    uid = syntax.encode() + b"\0" * (len(syntax) % 2)
    return bytes(128) + b"DICM" + struct.pack("<HH2sH", 2, 0x10, b"UI", len(uid)) + uid + data


@pytest.mark.parametrize("syntax", [dicom.EXPLICIT, dicom.IMPLICIT, dicom.BIG_ENDIAN, dicom.DEFLATED])
def test_syntaxes(syntax):
    nodes = ROWS if syntax != dicom.IMPLICIT else [r for r in ROWS if r[0] != 0x00189087]
    rows = dicom.parsed("f", in_syntax(nodes, syntax))
    by = {(r[3], tuple((p["tag"], p["item"]) for p in r[1])): r for r in rows}
    assert all(r[8] is None for r in rows)
    assert by[0x00100010, ()][5] == "Tan^Wei" and by[0x00100020, ()][6] == ["A", "B"] and by[0x00101002, ()][5] == "2"
    assert by[0x00100020, ((0x00101002, 1),)][5] == "Y"
    if syntax != dicom.IMPLICIT:
        assert by[0x00280010, ()][5] == "4" and by[0x00189087, ()][5] == "1.5"


def test_unreadable_files_are_rows():
    for raw in (b"", b"nothing", bytes(128) + b"DICM" + b"\x10\0", in_syntax(ROWS, dicom.EXPLICIT)[:-3], in_syntax(ROWS, dicom.DEFLATED)[:-9]):
        rows = dicom.parsed("f", raw)
        assert rows == [] or rows[0][0] == "f"
    assert dicom.parsed("f", b"nothing")[0][8]


@pytest.mark.parametrize(("shape", "dtype", "n"), [((5, 7, 1), "u1", 1), ((5, 7, 1), "u2", 3), ((4, 6, 3), "u1", 2), ((3, 3, 1), "i2", 1)])
def test_frames_round_trip(spark, shape, dtype, n):
    a = np.random.default_rng(2).integers(0, 120, (n, *shape)).astype(f"<{dtype}")
    a[:, 0] = 7  # runs
    head = [*corpus._record("1.2", 1), *[r for r in corpus._pixels(a[0], n) if r[0] != dicom.SIGNED], (dicom.SIGNED, "US", bytes([dtype[0] == "i", 0]))]
    plain = dicom.encoded([*head, (dicom.PIXELS, "OW", a.tobytes())])
    coded = dicom.encoded([*head, (dicom.PIXELS, "OB", dicom.Fragments([b"", *map(corpus.run_lengths, a)]))], dicom.RUN_LENGTH)
    jpeg = dicom.encoded([*head, (dicom.PIXELS, "OB", dicom.Fragments([b"", b"\xff\xd8"]))], "1.2.840.10008.1.2.4.50")
    assert all((np.array(dicom.pixel_arrays(x)) == a).all() for x in (plain, coded))
    files = spark.createDataFrame([("p", plain), ("c", coded), ("j", jpeg), ("x", b"no")], "file_id string, content binary")
    rows = dicom.frames(files)
    assert {r.file_id for r in rows.where("skipped is not null").collect()} == {"j", "x"}
    assert "no decoder for 1.2.840.10008.1.2.4.50" in rows.where("file_id = 'j'").first().skipped
    boxes = spark.createDataFrame([("c", 0, 1, 1, 2, 2)], "file_id string, frame int, x int, y int, w int, h int")
    stored = {r.file_id: bytes(r.content) for r in arrays.redacted_pixels(files, boxes).where("error is null").collect()}
    assert set(stored) == {"p", "c"} and (np.array(dicom.pixel_arrays(stored["p"])) == a).all()
    want = a.copy()
    want[0, 1:3, 1:3] = 0
    assert (np.array(dicom.pixel_arrays(stored["c"])) == want).all() and dicom.Parser(stored["c"]).syntax == dicom.EXPLICIT
    by = {r[3]: r[5] for r in dicom.parsed("c", stored["c"]) if not r[1]}
    assert by[0x00100020] == corpus.P["mrn"] and (n == 1 or by[dicom.N_FRAMES] == str(n))


def test_planes_are_interleaved():
    a = np.arange(2 * 3 * 3, dtype="u1").reshape(2, 3, 3)
    head = [r for r in corpus._pixels(a) if r[0] != dicom.PLANAR] + [(dicom.PLANAR, "US", b"\x01\x00")]
    raw = dicom.encoded([*head, (dicom.PIXELS, "OB", np.ascontiguousarray(a.transpose(2, 0, 1)).tobytes())])
    assert (dicom.pixel_arrays(raw)[0] == a).all()


def test_rewritten_records():
    raw = in_syntax(ROWS, dicom.BIG_ENDIAN)
    new = dicom.rewritten(raw, {(0x00100010,): "ANON^1", (0x00080018,): "2.25.7", (0x00101002, 1, 0x00100020): None, (0x00120062,): "YES"})
    p = dicom.Parser(new)
    by = {(r[3], len(r[1]), r[1][0]["item"] if r[1] else 0): r[5] for r in dicom.parsed("f", new)}
    assert by[0x00100010, 0, 0] == "ANON^1" and by[0x00120062, 0, 0] == "YES" and (0x00100020, 1, 1) not in by and by[0x00100020, 1, 0] == "X"
    assert by[0x00280010, 0, 0] == "4" and dict((t, v) for t, _, v in p.meta)[0x00020003].rstrip(b"\0") == b"2.25.7" and p.syntax == dicom.EXPLICIT


def test_corpus_and_acceptance(spark, tmp_path):
    for mode in ("irreversible", "reversible"):
        checks = {r.name: (r.passed, r.detail) for r in corpus.acceptance_run(spark, str(tmp_path / mode), mode).collect()}
        assert len(checks) == 7 and all(p for p, _ in checks.values()), checks
    names = sorted(p.name for p in (tmp_path / "irreversible" / "out").iterdir())
    assert len(names) == 12 and len(corpus.ENCODINGS) == 11
    raw = spark.read.format("binaryFile").load(str(tmp_path / "irreversible" / "in")).select(F.col("path").alias("file_id"), F.col("content").cast("string").alias("text"))
    from veildeck.operators import residual

    planted = spark.createDataFrame(corpus.PLANTED, "category string, value string")
    # Raw bytes hold all that isn't within a zipped file.
    assert residual.survivors(raw, planted).count() == len(corpus.PLANTED)
