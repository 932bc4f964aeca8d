"""Rules, elements, sidecars, residual scans, manifest, governance, learning, arrays."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veildeck.operators import arrays, elements, gazetteer, governance, keystore, learning, manifest, residual, rules, sidecars
from veildeck.plans import catalog as C

ELEMENTS = "file_id string, path array<struct<tag:long,item:int>>, ord int, tag long, vr string, value string, values array<string>, value_bin binary"


def record(spark):
    seq, top = [(0x00101002, 0)], []
    rows = [
        (top, 0x00100010, "PN", "Tan^Wei Ming"), (top, 0x00100020, "LO", "S1234567D"), (top, 0x00080050, "SH", "ACC-2024-000123"), (top, 0x00100030, "DA", "19700101"), (top, 0x00080020, "DA", "20240310"), (top, 0x00080021, "DA", "20240315"),
        (top, 0x00204000, "LT", "contact 91234567"), (top, 0x00081030, "LO", "Echo  for Wei Ming on 15/01/2024"), (top, 0x00101040, "LO", "Blk 123"), (top, 0x00111001, "LO", "Ramasamy"), (top, 0x0020000D, "UI", "1.2.3.4"),
        (top, 0x00101002, "SQ", "1"), (seq, 0x00100020, "LO", "G9876543N"), (seq, 0x00081155, "UI", "1.2.3.4"), (top, 0x00080080, "LO", "Clinic of Tan"), (top, 0x00080060, "CS", "US"), (top, 0x54000100, "SQ", "1"), ([(0x54000100, 0)], 0x003A0010, "LO", "voice"),
    ]
    return spark.createDataFrame([("f1", [{"tag": t, "item": i} for t, i in p], k, tag, vr, v, [], None) for k, (p, tag, vr, v) in enumerate(rows)], ELEMENTS)


@pytest.mark.parametrize("mode", ["remove", "shift"])
def test_record(spark, mode):
    profile = C.DEFAULT_PROFILE | {"dates": {"mode": mode, "offset_days_range": [-100, 100]}}
    salt = spark.createDataFrame([("s",)], "salt string")
    actions = rules.action_map(rules.catalog_rows(spark), mode)
    done = elements.deidentified(record(spark), actions, salt, profile).cache()
    got = {(r.tag, len(r.path)): r for r in done.collect()}
    assert got[0x00100010, 0].result.startswith("ANON^") and got[0x00204000, 0].code == "X"
    assert got[0x00081030, 0].result == "Echo for on" and got[0x00081030, 0].categories == ["date", "name"]
    assert got[0x00080080, 0].result == "Clinic of" and got[0x00080080, 0].code == "AUTO"
    assert got[0x00111001, 0].removed and got[0x00080060, 0].code == "NONE" and got[0x003A0010, 1].code == "GONE"
    assert got[0x0020000D, 0].result == got[0x00081155, 1].result != "1.2.3.4"
    if mode == "shift":
        from datetime import date

        a, b = (date.fromisoformat(f"{x[:4]}-{x[4:6]}-{x[6:]}") for x in (got[0x00080020, 0].result, got[0x00080021, 0].result))
        assert (b - a).days == 5
    else:
        assert got[0x00080020, 0].removed
    words = rules.dictionary(spark)
    recs = elements.records(done, words)
    assert {r.keyword for r in recs.where("auto").collect()} == {"InstitutionName"}
    walk = elements.crosswalk(recs)
    assert walk.where("original = 'S1234567D'").count() == 1 and elements.crosswalk(recs, reversible=False).count() == 0
    out = elements.output_elements(done).withColumn("values", F.array().cast("array<string>")).withColumn("value_bin", F.lit(None).cast("binary"))
    assert out.where(F.col("tag") == 0x00120062).first().value == "YES"
    found = residual.findings(elements.text_values(out, words))
    assert found.where("confident").count() == 0
    raw = residual.findings(elements.text_values(record(spark), words))
    assert {"nric_fin", "phone"} <= {r.category for r in raw.collect()}
    assert residual.survivors(out.selectExpr("file_id", "value as text"), spark.createDataFrame([("names", "Wei Ming"), ("nric_fin", "G9876543N")], "category string, value string")).count() == 0


def test_private_policy_and_pdf(spark):
    actions = rules.action_map(rules.catalog_rows(spark))
    kept = rules.dispatched(record(spark), actions, policy="keep_all").where(F.col("tag") == 0x00111001).first()
    assert kept.code == "AUTO"
    pdf = spark.createDataFrame([("f", [], 0, C.ENCAPSULATED_DOCUMENT, "OB", None, [], b"x")], ELEMENTS)
    assert [rules.dispatched(pdf, actions, pdf_mode=m).first().code for m in ("remove", "rasterize_redact")] == ["X", "SKIP"]


def test_keystore(spark, tmp_path):
    path = str(tmp_path / "k.json")
    k = keystore.Keystore(reversible=True)
    k.record("p", "100010", "Tan")
    k.save(spark, path, "secret")
    back = keystore.Keystore.open(spark, path, "secret")
    assert back.salt == k.salt and back.reverse("p")["original"] == "Tan" and os.stat(path).st_mode & 0o777 == 0o600
    with pytest.raises(ValueError, match="passphrase"):
        keystore.Keystore.open(spark, path, "wrong")
    one_way = keystore.Keystore()
    one_way.record("p", "c", "Tan")
    assert one_way.reverse("p") is None and one_way.crosswalk(spark).count() == 0


def test_sidecars(spark):
    text = json.dumps({"PatientName": "Tan^Ah Kow", "PatientID": "S1", "SeriesDescription": "for Ah Kow", "AcquisitionDateTime": "2024-01-15T10:00:00", "EchoTime": 0.03})
    side = spark.createDataFrame([("a/x.json", text), ("a/y.json", "[1]"), ("a/z.json", "{")], "file_id string, json string")
    rows = sidecars.entries(side)
    keys = rules.keyword_action(F.col("key"), rules.action_map(rules.catalog_rows(spark), "shift"), rules.dictionary(spark), "shift")
    done = sidecars.deidentified(rows, keys, spark.createDataFrame([("s",)], "salt string"), low=5, high=5)
    got = {r.key: r.result for r in done.where("file_id = 'a/x.json'").collect()}
    assert got == {"PatientName": None, "PatientID": None, "SeriesDescription": "for [REDACTED] [REDACTED]", "AcquisitionDateTime": "2024-01-20T10:00:00", "EchoTime": "0.03"}
    assert {r.file_id for r in done.collect()} == {"a/x.json", "a/y.json"}
    tree = sidecars.scrubbed_tree(spark.createDataFrame([("f", '{"a": ["x", {"b": "y"}], "c": 1}'), ("g", "{"), ("h", None)], "file_id string, json string"), lambda t: (t.upper(), 1))
    assert {r.file_id: (r.clean, r.n) for r in tree.collect()} == {"f": ('{"a": ["X", {"b": "Y"}], "c": 1}', 2), "g": (None, None), "h": (None, None)}


def test_manifest_is_idempotent(spark):
    none = spark.createDataFrame([], manifest.FILES)
    paths = spark.createDataFrame([("/in/a.dcm",), ("/in/sub/b.DCM",), ("/in/sub/c.nii",), ("/in/d.nii.gz",), ("/in/notes.txt",)], "path string")
    files = manifest.registered(none, manifest.scanned_files(paths), "b", "/in", "/out")
    rows = files.orderBy("id").collect()
    assert [(r.id, r.rel_in, r.output_path) for r in rows] == [(1, "a.dcm", "/out/a.dcm"), (2, "d.nii.gz", "/out/d.nii.gz"), (3, "sub/b.DCM", "/out/sub/b.DCM"), (4, "sub/c.nii", "/out/sub/c.nii")]
    held = spark.createDataFrame(rows, manifest.FILES)
    assert manifest.registered(held, manifest.scanned_files(paths), "b", "/in", "/out").count() == 4
    claimed = manifest.claimed(held, "w", "t", 2)
    assert [r.id for r in claimed.where("status = 'in_progress'").orderBy("id").collect()] == [1, 2]
    assert manifest.progress(manifest.reset_stale(claimed)).first().pending == 4
    moved = manifest.rebound(held, "/mnt/in", "/mnt/out").where("id = 3").first()
    assert (moved.input_path, moved.output_path) == ("/mnt/in/sub/b.DCM", "/mnt/out/sub/b.DCM")


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "audit.jsonl")
    for k in range(3):
        governance.audit_append(path, "run", f"u{k}", "deidentifier", {"k": k})
    governance.record_sign_off(path, "b", "ann", "bob", "reviewer", "pass")
    from veildeck.sources import files

    log = files.audit_log(spark, path)
    assert governance.verified(log).first().asDict() == {"ok": True, "n": 4, "broken_at": None}
    bad = governance.verified(log.withColumn("actor", F.when(F.col("seq") == 3, "x").otherwise(F.col("actor")))).first()
    assert (bad.ok, bad.broken_at) == (False, 3)
    with pytest.raises(PermissionError):
        governance.record_sign_off(path, "b", "ann", " ANN ", "reviewer", "pass")
    with pytest.raises(PermissionError):
        governance.record_sign_off(path, "b", "ann", "bob", "deidentifier", "pass")


def test_signatures(spark, tmp_path):
    f = str(tmp_path / "x.bin")
    with open(f, "wb") as h:
        h.write(b"data")
    _, public = governance.keypair(spark, str(tmp_path / "keys"))
    assert governance.signature_state(spark, f, public) == "missing_signature"
    sig = governance.signed(spark, f, str(tmp_path / "keys"), profile_id="default")
    assert governance.signature_state(spark, f, public) == "ok"
    with open(f, "ab") as h:
        h.write(b"!")
    assert governance.signature_state(spark, f, public) == "hash_mismatch"
    with open(f, "wb") as h:
        h.write(b"data")
    doc = json.load(open(sig)) | {"profile_id": "other"}
    json.dump(doc, open(sig, "w"))
    assert governance.signature_state(spark, f, public) == "bad_signature"
    open(sig, "w").write("{")
    assert governance.signature_state(spark, f, public) == "malformed_signature"


@pytest.mark.parametrize(("samples", "want"), [(["324-58-2995"], r"\b\d{3}\-\d{2}\-\d{4}\b"), (["A12-3456"], r"\b[A-Za-z]\d{2}\-\d{4}\b"), (["1234567", "12345678"], r"\b\d{7,8}\b"), (["(1)"], r"\(\d\)")])
def test_patterns(spark, samples, want):
    import re

    got = learning.derived_pattern(spark, samples)
    assert got == want and all(re.search(got, s) for s in samples)


def test_patterns_need_one_shape(spark):
    for bad in ([], ["  "], ["324-58-2995", "AB/12"]):
        with pytest.raises(ValueError, match="sample"):
            learning.derived_pattern(spark, bad)


def test_rules_and_capture(spark, tmp_path):
    profiles = C.Profiles(str(tmp_path))
    assert profiles.add_rule("default", "ref", r"R\d+") and not profiles.add_rule("default", "ref", r"R\d+")
    assert profiles.get()["_source"] == "workspace" and profiles.ids() == [("default", "workspace")]
    assert profiles.remove_rules("default") == 0 and profiles.remove_rules("default", "ref", "x") == 0 and profiles.remove_rules("default", "ref") == 1
    out = learning.capture(str(tmp_path), profiles, "names", " Tan ", fix=("gazetteer", "regex"), pattern="T.n", context="met Tan")
    learning.capture(str(tmp_path), profiles, "names", "TAN")
    assert [x["type"] for x in out["fix"]] == ["gazetteer", "regex"]
    from veildeck.sources import files

    assert [r.name for r in files.gazetteer(spark, [out["fix"][0]["path"]]).collect()] == ["Tan"]
    assert files.labelled_examples(spark, str(tmp_path / "labelled_examples.jsonl")).count() == 2
    with pytest.raises(ValueError, match="pattern"):
        learning.capture(str(tmp_path), profiles, "x", "y", fix=("regex",))
    assert C.pixel_autoredact(C.with_overrides(C.DEFAULT_PROFILE, autoredact=True)) and not C.pixel_autoredact(C.DEFAULT_PROFILE)


def test_gazetteer_join(spark):
    texts = spark.createDataFrame([(1, "Tan met TAN WEI, not Tanjong; o'sullivan"), (2, None), (3, "")], "key int, text string")
    names = spark.createDataFrame([("Tan",), ("Tan Wei",), ("O'Sullivan",), (" ",)], "name string")
    got = sorted((r.start, r.text) for r in gazetteer.hits(texts, names).collect())
    assert got == [(0, "Tan"), (8, "TAN"), (8, "TAN WEI"), (30, "o'sullivan")]


def test_frames(spark):
    a = np.full((2, 4, 5), 9, np.uint8)
    df = spark.createDataFrame(arrays.to_frames("f", a, 2), arrays.FRAMES)
    boxes = spark.createDataFrame([("f", None, -1, 0, 2, 2), ("f", 1, 3, 3, 9, 9)], "file_id string, frame int, x int, y int, w int, h int")
    got = {r.frame: np.frombuffer(r.data, r.dtype).reshape(r.h, r.w) for r in arrays.filled_frames(df, boxes).collect()}
    want = a.copy()
    want[:, 0:2, 0:2] = 0
    want[1, 3:, 3:] = 0
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_volumes_are_gated(spark):
    z, y, x = np.indices((18, 20, 20))
    ball = ((z - 9) ** 2 + (y - 10) ** 2 + (x - 10) ** 2 < 36) * 600.0
    cells = [(n, int(a), int(b), int(c), float(v[a, b, c])) for n, v in [("head", ball), ("ct", ball - 1000), ("slab", ball * 0 + (y > 3) * 5.0)] for a, b, c in np.ndindex(v.shape)]
    df = spark.createDataFrame(cells, "file_id string, z int, y int, x int, v double").repartition(3)
    modality = spark.createDataFrame([("head", "MR")], "file_id string, modality string")
    same, plan = arrays.defaced(df, modality)
    assert {r.file_id: r.reason for r in plan.collect()} == {"head": "deface model unavailable", "ct": "head-inclusive non-MR", "slab": "no-head-fov"}
    out, plan = arrays.defaced(df, modality, lambda v: v.where("z = 9 and y = 10 and x = 10").select("file_id", "z", "y", "x"), margin=1)
    assert df.where("v > 0 and file_id = 'head'").count() - out.where("v > 0 and file_id = 'head'").count() == 7
