"""Project folders and capability tables."""

import pytest

from veildeck.operators import projects


def test_projects(tmp_path):
    p = projects.Projects(str(tmp_path))
    p.create("one", keystore="project")
    two = p.create("two", copy_from="one", profile_id="x")
    assert p.ids() == ["one", "two"] and two["keystore"] == "project" and two["profile_id"] == "x"
    assert p.keystore_path("one").endswith("projects/one/keystore.json") and p.signing_folder("one").endswith("/signing")
    assert p.audit_path("one") != p.audit_path()
    with pytest.raises(FileExistsError):
        p.create("one")
    with pytest.raises(ValueError, match="id"):
        p.create("../x")


def test_tables(spark):
    assert projects.components(spark).where("secret").count() == 2
    assert projects.capabilities(spark).where("name = 'deterministic layers' and available").count() == 1
    rows = [("f", [], 0, 0x00280010, "US", "4"), ("f", [], 1, 0x00280011, "US", "5"), ("f", [], 2, 0x7FE00010, "OW", None), ("g", [], 0, 0x00280010, "US", "x")]
    df = spark.createDataFrame(rows, "file_id string, path array<struct<tag:long,item:int>>, ord int, tag long, vr string, value string")
    got = {r.file_id: (r.rows, r.columns, r.frames, r.has_pixels) for r in projects.pixel_info(df).collect()}
    assert got == {"f": (4, 5, 1, True), "g": (None, None, 1, False)}
