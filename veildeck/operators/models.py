"""Layers that need a model or a binary: names in free text, words in images, pages of documents.

Each is a plug-in that is loaded once in each Python worker and called in Arrow batches; rows stay where they
are. What can't be loaded, or fails, finds nothing and leaves a note; only documents, which can't be scanned
without it, are removed then. Words that an image holds are judged by the scanner's own columns.
"""

from __future__ import annotations

import io
import os
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import detectors as D
from ..functions import spans as S

# Labels of the layers, the categories that they stand for, least and default scores.
ENTITY_LABELS, ENTITY_LEAST = {"PERSON": "name", "LOCATION": "location"}, 0.35
NER_LABELS, NER_DEFAULT = {"PER": "name", "PERSON": "name", "LOC": "location"}, 0.5

#: start, end, label, score of what a model finds in a text; a score may be missing.
Found = list[tuple[int, int, str, float | None]]


@dataclass(frozen=True)
class ModelLayer:
    """source is the spans' own; load gives the model, a function of a text, or raises."""

    source: str
    load: Callable[[], Callable[[str], Found]]
    keep: dict[str, str] = field(default_factory=lambda: dict(ENTITY_LABELS))
    least: float = 0.0
    default: float = NER_DEFAULT


def entity_layer(load: Callable[[], Callable[[str], Found]], least: float = ENTITY_LEAST) -> ModelLayer:
    """Persons and places of an entity recogniser, from a least score on."""
    return ModelLayer("presidio", load, dict(ENTITY_LABELS), least)


def ner_layer(folder: str | None, load: Callable[[str], Callable[[str], Found]]) -> ModelLayer:
    """Persons and places of a token classifier in a local folder: nothing is ever fetched."""

    def local() -> Callable[[str], Found]:
        if not folder or not os.path.isdir(folder):
            raise FileNotFoundError("the model's folder isn't on this machine")
        return load(folder)

    return ModelLayer("ner", local, dict(NER_LABELS))


def _worker_cache() -> dict:
    return sys.modules.setdefault("_veildeck_models", types.ModuleType("_veildeck_models")).__dict__


def _loaded(key: str, load: Callable):
    """The plug-in, or the error that it gave, kept for the worker's life."""
    kept = _worker_cache()
    if key not in kept:
        try:
            kept[key] = (load(), None)
        except Exception as e:  # noqa: BLE001 - a layer that isn't there is a note
            kept[key] = (None, str(e) or type(e).__name__)
    return kept[key]


def model_spans(df: DataFrame, text: str, layers: list[ModelLayer], out: str = "model_spans", notes: str = "notes") -> DataFrame:
    """df with the layers' spans of a text column, in its characters, and notes of what was missing or failed."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("category", pa.string()), ("text", pa.string()), ("source", pa.string()), ("score", pa.float64())])
    run_id = os.urandom(8).hex()

    def one(value: str | None) -> tuple[list[dict], list[str]]:
        found, said = [], []
        for k, layer in enumerate(layers):
            model, error = _loaded(f"{run_id}-{k}", layer.load)
            if error is not None:
                said.append(f"{layer.source} unavailable: {error}")
                continue
            try:
                for start, end, label, score in model(value) if value else ():
                    score = layer.default if score is None else float(score)
                    if label in layer.keep and score >= layer.least and 0 <= start < end <= len(value):
                        found.append({"start": start, "end": end, "category": layer.keep[label], "text": value[start:end], "source": layer.source, "score": score})
            except Exception as e:  # noqa: BLE001 - one text's fault is that text's note
                said.append(f"{layer.source} failed: {e}")
        return found, said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(v) for v in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in got], pa.list_(span)), pa.array([n for _, n in got], pa.list_(pa.string()))], [*b.schema.names[:-1], out, notes])

    rows = df.select("*", F.col(text).cast("string").alias("__text"))
    spans = T._parse_datatype_string(S.SPANS)
    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, spans), T.StructField(notes, T.ArrayType(T.StringType()))]))


def scanned(df: DataFrame, text: str, scanner: D.Scanner | None = None, layers: list[ModelLayer] | None = None, known: str | None = None, out: str = "spans") -> DataFrame:
    """The scanner's spans and the models', merged; with notes."""
    scanner = scanner or D.Scanner()
    rows = model_spans(df, text, layers or [], "__model")
    raw = D.raw(rows, text, scanner, known, "__found", F.col("__model"))
    return S.once(raw, out, S.merge(F.col("__found"))).drop("__found", "__model")


# --- recognisers with scores of their own

# Formats and scores of the registered recognisers.
PHONE_ABROAD, PHONE_LOCAL = r"\+?65[\s-]?[3689]\d{3}[\s-]?\d{4}\b", r"\b[3689]\d{3}[\s-]?\d{4}\b"
POSTAL, POSTAL_SHORT = r"\bSingapore\s+\d{6}\b", r"\bS\(\d{6}\)"
RECOGNISERS = [("SG_TEMP_IC", r"\b[XY](?:\d{7}|\d{10})[A-Z]\b", 0.6), ("SG_CASE_NUMBER", r"\b\d{10}[A-Za-z]\b", 0.5), ("SG_PHONE", PHONE_ABROAD, 0.7), ("SG_PHONE", PHONE_LOCAL, 0.4), ("SG_POSTAL", POSTAL, 0.6), ("SG_POSTAL", POSTAL_SHORT, 0.6)]


def recognised(text):
    """Spans of the registered recognisers, overlaps and all: a number with a wrong check letter is none, one
    without a check letter counts half, and a right one whole."""
    letter = lambda m: D.nric_letter(F.substring(m, 1, 1), F.substring(m, 2, 7))
    right = lambda m: letter(m).isNull() | (letter(m) == F.substring(m, 9, 1))
    numbers = S.find(text, D.NRIC, lambda a, b, m: S.span(a, b, "SG_NRIC_FIN", m, "presidio", F.when(letter(m).isNull(), 0.5).otherwise(1.0)), right)
    others = [S.find(text, p, lambda a, b, m, c=c, s=s: S.span(a, b, c, m, "presidio", s)) for c, p, s in RECOGNISERS]
    return F.concat(numbers, *others)


# --- words in images

WORDS = "file_id string, frame int, x int, y int, w int, h int, text string, note string"
#: text and box (x, y, w, h) of each word that a reader finds in an image of 8 bits.
Reader = Callable[[np.ndarray], list[tuple[str, int, int, int, int]]]


def eight_bit(frame: np.ndarray) -> np.ndarray:
    """An image stretched to 0 to 255; all 0 where it has one value."""
    a = frame.astype(np.float64)
    low, high = (a.min(), a.max()) if a.size else (0.0, 0.0)
    return np.zeros(a.shape, np.uint8) if high == low else ((a - low) / (high - low) * 255).astype(np.uint8)


def tesseract() -> Reader:
    """The reader that pytesseract gives, where it and its binary are installed."""
    import pytesseract

    binary = os.environ.get("VEILDECK_TESSERACT")
    if binary and os.path.isfile(binary):
        pytesseract.pytesseract.tesseract_cmd = binary
    pytesseract.get_tesseract_version()

    def read(image: np.ndarray):
        d = pytesseract.image_to_data(image, output_type=pytesseract.Output.DICT)
        return list(zip(d["text"], d["left"], d["top"], d["width"], d["height"], strict=True))

    return read


def words_in(frames: DataFrame, load: Callable[[], Reader] = tesseract) -> DataFrame:
    """A row for each word of each frame (file_id, frame, h, w, c, dtype, data); for a frame that can't be
    read, or a reader that isn't there, one with a note and no text."""
    key = os.urandom(8).hex()

    def rows(r: dict):
        read, error = _loaded(key, load)
        none = (r["file_id"], r["frame"], None, None, None, None, None)
        if error is not None:
            yield (*none, f"ocr unavailable: {error}")
            return
        try:
            image = eight_bit(np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"], r["c"]))
            for text, *box in read(image[..., 0] if r["c"] == 1 else image):
                if text and text.strip():
                    yield (r["file_id"], r["frame"], *map(int, box), text, None)
        except Exception as e:  # noqa: BLE001 - one image's fault is its note
            yield (*none, f"ocr failed on frame {r['frame']}: {e}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int32()] * 5, pa.string(), pa.string()]
        for b in batches:
            found = [x for r in b.to_pylist() for x in rows(r)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], [f.split()[0] for f in WORDS.split(", ")])

    return frames.select("file_id", "frame", "h", "w", "c", "dtype", "data").mapInArrow(run, WORDS)


def boxes_of(words: DataFrame, scanner: D.Scanner | None = None, stop_at_failure: bool = True) -> tuple[DataFrame, DataFrame]:
    """Boxes (file_id, frame, x, y, w, h, text, source) of the words that the scanner flags, and a note for each
    file that has one. After a file's first frame that failed nothing more is kept of it, unless failing
    frames are only passed over, as in volumes."""
    bad = words.where("note is not null").groupBy("file_id").agg(F.min("frame").alias("failed"), F.min_by("note", "frame").alias("note"))
    kept = words.where("note is null")
    if stop_at_failure:
        kept = kept.join(bad.select("file_id", "failed"), "file_id", "left").where("failed is null or frame < failed")
    found = D.scanned(kept, "text", scanner).where(F.size("spans") > 0)
    return found.select("file_id", "frame", "x", "y", "w", "h", "text", F.lit("ocr").alias("source")), bad.select("file_id", "note")


def slices(volumes: DataFrame, axis: int | None = None) -> DataFrame:
    """Frames (and axis) of volumes (file_id, n0, n1, n2, dtype, data): planes along the shortest axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                v = np.frombuffer(r["data"], r["dtype"]).reshape(r["n0"], r["n1"], r["n2"])
                ax = int(np.argmin(v.shape)) if axis is None else axis
                for k in range(v.shape[ax]):
                    plane = np.take(v, k, axis=ax)
                    yield pa.RecordBatch.from_pylist([{"file_id": r["file_id"], "frame": k, "h": plane.shape[0], "w": plane.shape[1], "c": 1, "dtype": r["dtype"], "data": plane.tobytes(), "axis": ax}], schema)

    schema = pa.schema([("file_id", pa.string()), *[(x, pa.int32()) for x in ("frame", "h", "w", "c")], ("dtype", pa.string()), ("data", pa.binary()), ("axis", pa.int32())])
    return volumes.select("file_id", "n0", "n1", "n2", "dtype", "data").mapInArrow(run, "file_id string, frame int, h int, w int, c int, dtype string, data binary, axis int")


def filled_volume(cells: DataFrame, boxes: DataFrame, fill: float = 0) -> DataFrame:
    """cells (file_id, z, y, x, v) with v set within boxes (file_id, axis, slice, x, y, w, h) of a plane."""
    per = boxes.where("w > 0 and h > 0").groupBy("file_id").agg(F.collect_set(F.struct("axis", "slice", F.greatest("x", F.lit(0)).alias("x"), F.greatest("y", F.lit(0)).alias("y"), (F.greatest("x", F.lit(0)) + F.col("w")).alias("x1"), (F.greatest("y", F.lit(0)) + F.col("h")).alias("y1"))).alias("boxes"))
    at = F.array("z", "y", "x")
    rest = lambda a, k: F.when(a == 0, F.array("y", "x")).when(a == 1, F.array("z", "x")).otherwise(F.array("z", "y"))[k]
    inside = F.exists("boxes", lambda b: (F.get(at, b["axis"]) == b["slice"]) & (rest(b["axis"], 0) >= b["y"]) & (rest(b["axis"], 0) < b["y1"]) & (rest(b["axis"], 1) >= b["x"]) & (rest(b["axis"], 1) < b["x1"]))
    return cells.join(per, "file_id", "left").withColumn("v", F.when(F.coalesce(inside, F.lit(False)), F.lit(fill).cast("double")).otherwise(F.col("v"))).select(*cells.columns)


# --- documents as pages

PDF_MIME, PDF_SOP = "application/pdf", "1.2.840.10008.5.1.4.1.1.104.1"
#: Pages of a document as images (h, w, 3) of 8 bits, at so many dots an inch.
Renderer = Callable[[bytes, int], list[np.ndarray]]


def pdfium() -> Renderer:
    """The renderer that pypdfium2 gives, where it is installed."""
    import pypdfium2

    def render(content: bytes, dpi: int) -> list[np.ndarray]:
        doc = pypdfium2.PdfDocument(content)
        try:
            return [np.asarray(page.render(scale=dpi / 72).to_pil().convert("RGB"), np.uint8) for page in doc]
        finally:
            doc.close()

    return render


def flat_pdf(pages: list[np.ndarray]) -> bytes:
    """A document of one image a page, without any text."""
    if not pages:
        raise ValueError("a document without pages")
    n = len(pages)
    kids = " ".join(f"{3 + 3 * k} 0 R" for k in range(n))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {n} >>".encode()]
    for k, page in enumerate(pages):
        h, w = page.shape[:2]
        data = zlib.compress(np.ascontiguousarray(page, np.uint8).tobytes())
        draw = f"q {w} 0 0 {h} 0 0 cm /I Do Q".encode()
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w} {h}] /Contents {4 + 3 * k} 0 R /Resources << /XObject << /I {5 + 3 * k} 0 R >> >> >>".encode())
        objects.append(f"<< /Length {len(draw)} >>\nstream\n".encode() + draw + b"\nendstream")
        objects.append(f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream")
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for k, body in enumerate(objects, 1):
        places.append(out.tell())
        out.write(f"{k} 0 obj\n".encode() + body + b"\nendobj\n")
    start = out.tell()
    out.write(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places))
    out.write(f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
    return out.getvalue()


def page_frames(documents: DataFrame, load: Callable[[], Renderer] = pdfium, dpi: int = 150) -> DataFrame:
    """Frames of documents (file_id, content), a page each; a document that can't be rendered has one row with
    a note and no data."""
    key = os.urandom(8).hex()
    schema = pa.schema([("file_id", pa.string()), *[(x, pa.int32()) for x in ("frame", "h", "w", "c")], ("dtype", pa.string()), ("data", pa.binary()), ("note", pa.string())])

    def rows(file_id: str, content: bytes):
        render, error = _loaded(key, load)
        try:
            if error is not None:
                raise RuntimeError(error)
            pages = render(content, dpi)
            if not pages:
                raise ValueError("a document without pages")
            return [{"file_id": file_id, "frame": k, "h": p.shape[0], "w": p.shape[1], "c": 3, "dtype": "|u1", "data": np.ascontiguousarray(p).tobytes(), "note": None} for k, p in enumerate(pages)]
        except Exception as e:  # noqa: BLE001 - what can't be rendered can't be kept
            return [{"file_id": file_id, "note": f"pages not rendered: {e}"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(rows(i, content or b""), schema)

    return documents.select("file_id", "content").mapInArrow(run, "file_id string, frame int, h int, w int, c int, dtype string, data binary, note string")


def redacted_documents(documents: DataFrame, render: Callable[[], Renderer] = pdfium, read: Callable[[], Reader] = tesseract, scanner: D.Scanner | None = None, dpi: int = 150) -> DataFrame:
    """file_id, mode, content, pages, boxes and note of documents (file_id, content): pages rendered, words that
    the scanner flags filled, flattened. Fails closed: whatever goes wrong, the document is removed."""
    from .arrays import filled_frames

    pages = page_frames(documents, render, dpi)
    words = words_in(pages.where("note is null"), read)
    boxes, notes = boxes_of(words, scanner)
    filled = filled_frames(pages.where("note is null").drop("note"), boxes.select("file_id", "frame", "x", "y", "w", "h"))

    def run(rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda r: r["frame"])
        flat = flat_pdf([np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 3) for r in found])
        return pa.table({"file_id": [found[0]["file_id"]], "content": pa.array([flat + b"\0" * (len(flat) % 2)], pa.binary()), "pages": pa.array([len(found)], pa.int32())})

    flat = filled.groupBy("file_id").applyInArrow(run, "file_id string, content binary, pages int")
    trouble = pages.where("note is not null").select("file_id", "note").unionByName(notes).groupBy("file_id").agg(F.min("note").alias("note"))
    counts = boxes.groupBy("file_id").agg(F.count("*").cast("int").alias("boxes"))
    out = documents.select("file_id").distinct().join(flat, "file_id", "left").join(trouble, "file_id", "left").join(counts, "file_id", "left")
    kept = F.col("note").isNull() & F.col("content").isNotNull()
    when = lambda x: F.when(kept, x)
    return out.select("file_id", F.when(kept, "rasterize_redact").otherwise("removed_fallback").alias("mode"), when(F.col("content")).alias("content"), when(F.col("pages")).alias("pages"), when(F.coalesce("boxes", F.lit(0))).alias("boxes"), F.when(~kept, F.coalesce("note", F.lit("no pages"))).alias("note"))

