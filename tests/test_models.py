"""Layers that need a model, a reader or a renderer, with stubs for each."""

import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from veildeck.functions import detectors as D
from veildeck.operators import arrays, models

# Workers don't have this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stub():
    def find(text):
        if "break" in text:
            raise RuntimeError("no")
        found = [(m.start(), m.end(), "PERSON", 0.9) for m in re.finditer(r"Mr [A-Z]\w+", text)]
        found += [(m.start(), m.end(), "LOCATION", 0.3) for m in re.finditer(r"at [A-Z]\w+", text)]
        return found + [(m.start(), m.end(), "ORG", 0.99) for m in re.finditer(r"Inc\b", text)] + [(m.start(), m.end(), "PER", None) for m in re.finditer(r"Dr [A-Z]\w+", text)]

    return find


def missing():
    raise ImportError("no model here")


ROWS = [(1, "é Mr Lim met Mr Tan at Oslo for Inc"), (2, "break Mr Lim"), (3, None), (4, ""), (5, "Dr Who called 91234567")]


def test_model_layers(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "k int, text string")
    got = {r.k: r for r in models.model_spans(df, "text", [models.entity_layer(stub), models.ner_layer(None, lambda f: stub())]).collect()}
    assert [(s.start, s.end, s.category, s.text, s.source) for s in got[1].model_spans] == [(2, 8, "name", "Mr Lim", "presidio"), (13, 19, "name", "Mr Tan", "presidio")]
    assert got[2].model_spans == [] and any("presidio failed: no" in n for n in got[2].notes)
    assert all(any(n.startswith("ner unavailable") for n in r.notes) for r in got.values())
    ner = {r.k: r.model_spans for r in models.model_spans(df, "text", [models.ner_layer(str(tmp_path), lambda f: stub())]).collect()}
    assert [(s.category, s.score) for s in ner[5]] == [("name", 0.5)] and [s.category for s in ner[1]] == ["name", "name"]
    none = models.model_spans(df, "text", [models.entity_layer(missing)]).collect()
    assert all(r.model_spans == [] and r.notes == ["presidio unavailable: no model here"] for r in none)
    merged = {r.k: [(s.category, s.text) for s in r.spans] for r in models.scanned(df, "text", D.Scanner(), [models.entity_layer(stub, 0.2)]).collect()}
    assert merged[1] == [("name", "Mr Lim"), ("name", "Mr Tan"), ("location", "at Oslo")] and merged[5] == [("phone", "91234567")] and merged[3] == []


def test_recognisers(spark):
    texts = ["S1234567D and S1234567A, M1234567K", "X1234567A Y1234567890B 1234567890Z", "+65 9123 4567", "91234567", "Singapore 570123 or S(570123)", "X12345678A"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: sorted((s.category, s.text, s.score) for s in r.s) for r in df.select("k", models.recognised(df.text).alias("s")).collect()}
    assert got[0] == [("SG_NRIC_FIN", "M1234567K", 0.5), ("SG_NRIC_FIN", "S1234567D", 1.0)]
    assert got[1] == [("SG_CASE_NUMBER", "1234567890Z", 0.5), ("SG_TEMP_IC", "X1234567A", 0.6), ("SG_TEMP_IC", "Y1234567890B", 0.6)]
    assert got[2] == [("SG_PHONE", "+65 9123 4567", 0.7), ("SG_PHONE", "9123 4567", 0.4)] and got[3] == [("SG_PHONE", "91234567", 0.4)]
    assert got[4] == [("SG_POSTAL", "S(570123)", 0.6), ("SG_POSTAL", "Singapore 570123", 0.6)] and got[5] == []


def reader():
    def read(image):
        if image.max() == 0:
            raise ValueError("blank")
        return [("91234567", 1, 2, 3, 2), ("hello", 0, 0, 1, 1), ("  ", 0, 0, 1, 1)]

    return read


def frames_of(spark, shapes):
    rows = []
    for name, n, blank in shapes:
        a = np.arange(n * 6 * 8, dtype="<u2").reshape(n, 6, 8)
        if blank is not None:
            a[blank] = 5
        rows += arrays.to_frames(name, a, n)
    return spark.createDataFrame(rows, arrays.FRAMES)


def test_words_in_frames(spark):
    frames = frames_of(spark, [("a", 3, None), ("b", 3, 1)])
    words = models.words_in(frames, reader)
    boxes, notes = models.boxes_of(words)
    assert sorted((r.file_id, r.frame, r.x, r.y, r.w, r.h, r.text) for r in boxes.collect()) == [("a", 0, 1, 2, 3, 2, "91234567"), ("a", 1, 1, 2, 3, 2, "91234567"), ("a", 2, 1, 2, 3, 2, "91234567"), ("b", 0, 1, 2, 3, 2, "91234567")]
    assert {r.file_id: r.note for r in notes.collect()} == {"b": "ocr failed on frame 1: blank"}
    passed, _ = models.boxes_of(words, stop_at_failure=False)
    assert passed.where("file_id = 'b'").count() == 2
    none, said = models.boxes_of(models.words_in(frames, missing))
    assert none.count() == 0 and all("ocr unavailable" in r.note for r in said.collect())
    assert (models.eight_bit(np.array([[1, 3]])) == [[0, 255]]).all() and models.eight_bit(np.ones((2, 2))).max() == 0


def test_words_in_volumes(spark):
    a = np.arange(3 * 6 * 8, dtype="<i2").reshape(6, 3, 8)
    vol = spark.createDataFrame([("v", 6, 3, 8, "<i2", a.tobytes())], "file_id string, n0 int, n1 int, n2 int, dtype string, data binary")
    planes = models.slices(vol)
    assert planes.count() == 3 and planes.first().axis == 1 and (planes.first().h, planes.first().w) == (6, 8)
    boxes, _ = models.boxes_of(models.words_in(planes, reader), stop_at_failure=False)
    cells = spark.createDataFrame([("v", z, y, x, float(a[z, y, x])) for z in range(6) for y in range(3) for x in range(8)], "file_id string, z int, y int, x int, v double")
    out = models.filled_volume(cells, boxes.selectExpr("file_id", "1 as axis", "frame as slice", "x", "y", "w", "h"), -1.0)
    want = a.astype(float)
    want[2:4, :, 1:4] = -1
    assert all(r.v == want[r.z, r.y, r.x] for r in out.collect())


def renderer():
    def render(content, dpi):
        if content == b"bad":
            raise ValueError("encrypted")
        return [np.arange(6 * 8 * 3, dtype=np.uint8).reshape(6, 8, 3) for _ in range(content[0])]

    return render


@pytest.mark.parametrize(("load", "read", "kept"), [(renderer, reader, {"two"}), (missing, reader, set()), (renderer, missing, set())])
def test_documents_fail_closed(spark, load, read, kept):
    docs = spark.createDataFrame([("two", b"\x02"), ("bad", b"bad"), ("none", b"\x00"), ("empty", None)], "file_id string, content binary")
    got = {r.file_id: r for r in models.redacted_documents(docs, load, read).collect()}
    assert len(got) == 4 and {k for k, r in got.items() if r.mode == "rasterize_redact"} == kept
    assert all(r.content is None and r.note for k, r in got.items() if k not in kept)
    for k in kept:
        assert (got[k].pages, got[k].boxes) == (2, 2) and bytes(got[k].content).startswith(b"%PDF-1.4") and b"/Count 2" in bytes(got[k].content) and b"/Font" not in bytes(got[k].content)
