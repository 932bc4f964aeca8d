"""A small corpus of files in eleven encodings with planted identifiers, and an acceptance run over it."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays, elements, manifest, models, residual, rules, sidecars
from ..sources import dicom, files, volumes

#: What is planted, by category; each value stands somewhere in the corpus.
PLANTED = [("names", "Okonkwo Adaeze"), ("nric_fin", "S1234567D"), ("temp_ic", "X7654321B"), ("case_number", "9876543210C"), ("phone", "+65 9123 4567"), ("email", "adaeze@example.sg"), ("dates", "15/01/2024"), ("mrn", "MRN4471"), ("accession", "ACC-77-0042"), ("address", "12 Quay Lane")]
ENCODINGS = ("single_frame", "multiframe_cine", "rgb", "run_length", "nifti", "nifti2", "nifti_pair", "bids_sidecar", "encapsulated_pdf", "nifti_head_mr", "nifti_burned_in")
P = dict(PLANTED)


def _record(sop: str, n: int, modality: str = "US") -> list[tuple]:
    """Identifiers in structured tags, free text, a private tag and a nested sequence."""
    return [
        (0x00080016, "UI", sop), (0x00080018, "UI", f"1.2.826.99.{n}"), (0x00080020, "DA", "20240115"), (0x00080050, "SH", P["accession"]), (0x00080060, "CS", modality),
        (0x00081030, "LO", f"Echo of {P['names']} on {P['dates']}"), (0x00100010, "PN", P["names"].replace(" ", "^")), (0x00100020, "LO", P["mrn"]), (0x00101040, "LO", P["address"]),
        (0x00081155, "UI", "1.2.3.4"), (0x00101002, "SQ", [[(0x00100020, "LO", P["nric_fin"])]]), (0x00111001, "LO", f"note {P['temp_ic']}"), (0x00204000, "LT", f"call {P['phone']} or {P['email']}, case {P['case_number']}"),
    ]


def _pixels(a: np.ndarray, n: int = 1) -> list[tuple]:
    """Image elements of (h, w, c) or n frames of it."""
    h, w, c = a.shape[-3:]
    u = lambda x: int(x).to_bytes(2, "little")
    rows = [(dicom.SAMPLES, "US", u(c)), (dicom.ROWS, "US", u(h)), (dicom.COLUMNS, "US", u(w)), (dicom.BITS, "US", u(8 * a.dtype.itemsize)), (dicom.SIGNED, "US", u(0))]
    return rows + ([(dicom.N_FRAMES, "IS", str(n))] if n > 1 else []) + ([(dicom.PLANAR, "US", u(0))] if c > 1 else [])


def run_lengths(a: np.ndarray) -> bytes:
    """One frame (h, w, c), run-length coded in literal runs of at most 128 bytes."""
    planes = [a[..., s].astype(a.dtype.newbyteorder(">")).tobytes()[b :: a.dtype.itemsize] for s in range(a.shape[-1]) for b in range(a.dtype.itemsize)]
    coded = []
    for p in planes:
        x = b"".join(bytes([len(p[k : k + 128]) - 1]) + p[k : k + 128] for k in range(0, len(p), 128))
        coded.append(x + b"\0" * (len(x) % 2))
    places = np.cumsum([64, *map(len, coded)])[:-1]
    return np.array([len(coded), *places, *[0] * (15 - len(coded))], "<u4").tobytes() + b"".join(coded)


def build(folder: str) -> list[str]:
    """Writes one file of each encoding (a pair is two) below a folder; returns their relative paths."""
    rng = np.random.default_rng(5)
    gray = lambda *s: rng.integers(0, 200, (*s, 1)).astype("<u2")
    one, cine, color = gray(24, 32), gray(3, 16, 16), rng.integers(0, 255, (20, 20, 3)).astype("u1")
    us = "1.2.840.10008.5.1.4.1.1.6.1"
    z, y, x = np.mgrid[:20, :24, :24]
    ball = np.where((z - 10) ** 2 + (y - 12) ** 2 + (x - 12) ** 2 < 49, 600, 0).astype("<i2")
    made = {
        "single_frame.dcm": dicom.encoded([*_record(us, 1), *_pixels(one), (dicom.PIXELS, "OW", one.tobytes())]),
        "multiframe_cine.dcm": dicom.encoded([*_record(us, 2), *_pixels(cine[0], 3), (dicom.PIXELS, "OW", cine.tobytes())]),
        "rgb.dcm": dicom.encoded([*_record(us, 3), *_pixels(color), (dicom.PIXELS, "OB", color.tobytes())]),
        "run_length.dcm": dicom.encoded([*_record(us, 4), *_pixels(one), (dicom.PIXELS, "OB", dicom.Fragments([b"", run_lengths(one)]))], dicom.RUN_LENGTH),
        "encapsulated_pdf.dcm": dicom.encoded([*_record(models.PDF_SOP, 5, "DOC"), (0x00420012, "LO", models.PDF_MIME), (0x00420011, "OB", models.flat_pdf([np.zeros((8, 8, 3), np.uint8)]))]),
        "nifti.nii.gz": volumes.made(rng.random((4, 5, 6)).astype("f4"), f"of {P['names']}", 1, True),
        "nifti2.nii": volumes.made(rng.random((4, 5, 6)).astype("f4"), P["mrn"], 2),
        "nifti_pair.nii": volumes.made(rng.random((3, 3, 3)).astype("f4"), P["nric_fin"]),
        "nifti_pair.json": json.dumps({"PatientName": P["names"], "Note": P["email"]}).encode(),
        "bids_sidecar.json": json.dumps({"PatientID": P["mrn"], "PatientName": P["names"], "AcquisitionDateTime": "2024-01-15T10:20:30", "SeriesDescription": f"scan of {P['names']} call {P['phone']}"}).encode(),
        "nifti_head_mr.nii.gz": volumes.made(ball, "head", 1, True),
        "nifti_burned_in.nii": volumes.made((ball // 3).astype("<i2"), P["phone"]),
    }
    os.makedirs(folder, exist_ok=True)
    for name, content in made.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(content)
    return sorted(made)


def _texts(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """file_id and every text that the outputs hold: of elements, headers and sidecars."""
    found = dicom.elements(raw.where("file_id like '%.dcm'"))
    heads = volumes.headers(raw.where(volumes.is_nifti(F.col("file_id")))).select("file_id", F.concat_ws(" ", "descrip", "aux_file", "intent_name").alias("text"))
    side = raw.where("file_id like '%.json'").select("file_id", F.col("content").cast("string").alias("text"))
    return elements.text_values(found.drop("skipped"), rules.dictionary(spark)).select("file_id", "tag", "keyword", "text").unionByName(heads.unionByName(side).select("file_id", F.lit(0).cast("long").alias("tag"), F.lit("").alias("keyword"), "text"))


def treated(spark: SparkSession, raw: DataFrame, salt: DataFrame, mode: str = "shift") -> tuple[DataFrame, DataFrame]:
    """Outputs (file_id, content, error) of files (file_id, content) of all encodings, and the change records."""
    actions = rules.action_map(rules.catalog_rows(spark), mode)
    record = elements.deidentified(dicom.elements(raw.where("file_id like '%.dcm'")).where("skipped is null").drop("skipped"), actions, salt)
    changes = record.where("changed or removed").select("file_id", "path", "tag", "result", "removed")
    marks = record.select("file_id").distinct().select("file_id", F.array().cast("array<struct<tag:bigint,item:int>>").alias("path"), F.lit(0x00120062).cast("long").alias("tag"), F.lit("YES").alias("result"), F.lit(False).alias("removed"))
    images = dicom.rewritten_files(raw.where("file_id like '%.dcm'"), changes.unionByName(marks))
    brain = volumes.cleaned(raw.where(volumes.is_nifti(F.col("file_id"))))
    rows = sidecars.entries(raw.where("file_id like '%.json'").select("file_id", F.col("content").cast("string").alias("json")))
    keys = rules.keyword_action(F.col("key"), actions, rules.dictionary(spark), mode)
    done = sidecars.deidentified(rows, keys, salt)
    side = done.where("result is not null").groupBy("file_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "result")))).cast("binary").alias("content")).withColumn("error", F.lit(None).cast("string"))
    return images.unionByName(brain).unionByName(side), elements.records(record)


def written(outputs: DataFrame, folder: str) -> DataFrame:
    """Outputs written below a folder that all executors see, each under its own relative path: file_id, bytes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.part", path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["file_id", "bytes"])

    return outputs.where("content is not null").select("file_id", "content").mapInArrow(run, "file_id string, bytes long")


def acceptance_run(spark: SparkSession, folder: str, mode: str = "irreversible") -> DataFrame:
    """Builds the corpus below folder/in, writes its outputs to folder/out, reads them again, and gives the
    seven checks. A second run is registered over the first one's manifest, to see what it would take up."""
    source, target = os.path.join(folder, "in"), os.path.join(folder, "out")
    build(source)
    read = lambda f: files.tree(spark, f, content=True).select(F.col("rel").alias("file_id"), "content")
    raw = read(source)
    made, records = treated(spark, raw, spark.createDataFrame([("pepper",)], "salt string"))
    sizes = written(made, target).collect()
    out = read(target)
    texts = _texts(spark, out)
    found = residual.findings(texts)
    scanned = out.select("file_id", F.lit(True).alias("identity_removed"), F.lit(None).cast("string").alias("skipped"))
    bad = dicom.elements(out.where("file_id like '%.dcm'")).where("skipped is not null").select("file_id").unionByName(volumes.headers(out.where(volumes.is_nifti(F.col("file_id")))).where("error is not null").select("file_id"))
    walk = elements.crosswalk(records, reversible=mode == "reversible")
    back = elements.reidentified(walk.select("pseudonym").distinct(), walk).select(F.col("pseudonym").alias("p"), F.col("original").alias("restored"))
    first = manifest.registered(spark.createDataFrame([], manifest.FILES), raw.select(F.concat(F.lit(source + "/"), "file_id").alias("path")), "b1", source, target)
    done = spark.createDataFrame([(os.path.join(source, r.file_id),) for r in sizes], "done string")
    finished = first.join(done, F.col("input_path") == F.col("done"), "left").withColumn("status", F.when(F.col("done").isNotNull(), "done").otherwise(F.col("status"))).drop("done")
    second = manifest.registered(finished, raw.select(F.concat(F.lit(source + "/"), "file_id").alias("path")), "b1", source, target)
    heads = raw.where(volumes.is_nifti(F.col("file_id")))
    _, plan = arrays.defaced(volumes_cells(heads), heads.select("file_id", F.lit("MR").alias("modality")), None)
    return residual.acceptance_checks(raw.select("file_id"), out.select("file_id"), residual.survivors(texts.select("file_id", "text"), spark.createDataFrame(PLANTED, "category string, value string")), residual.batch(residual.verdicts(scanned, found)), bad, walk.join(back, F.col("pseudonym") == F.col("p")), residual.reprocessed(finished, second), residual.face_counts(plan.withColumn("deface_error", F.lit(None).cast("string"))), mode)


def volumes_cells(raw: DataFrame) -> DataFrame:
    """file_id, z, y, x, v of files of three dimensions, a plane a batch."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = volumes.Volume(content).array()
                for k in range(a.shape[0]) if a.ndim == 3 else ():
                    y, x = np.indices(a.shape[1:]).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(y)), pa.array(np.full(len(y), k, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(a[k].reshape(-1).astype(float))], ["file_id", "z", "y", "x", "v"])

    return raw.select("file_id", "content").mapInArrow(run, "file_id string, z int, y int, x int, v double")
