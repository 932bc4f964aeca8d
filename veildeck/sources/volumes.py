"""NIfTI headers in Arrow batches: bytes in, fields or cleaned bytes out."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

# Fixed values of the NIfTI-1 and NIfTI-2 formats: header size, places of dim, datatype, vox_offset, and of
# the text fields; numpy types of the datatypes.
LAYOUT = {
    348: {"dim": (40, "8h"), "datatype": (70, "h"), "vox_offset": (108, "f"), "descrip": (148, 80), "aux_file": (228, 24), "intent_name": (328, 16), "extension": 348},
    540: {"dim": (16, "8q"), "datatype": (12, "h"), "vox_offset": (168, "q"), "descrip": (240, 80), "aux_file": (320, 24), "intent_name": (508, 16), "extension": 540},
}
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
TEXT_FIELDS = ("descrip", "aux_file", "intent_name")
HEADER = "file_id string, version int, shape array<long>, datatype int, descrip string, aux_file string, intent_name string, n_extensions int, error string"


def is_nifti(path: Column) -> Column:
    return path.rlike(r"(?i)\.nii(\.gz)?$")


class Volume:
    def __init__(self, content: bytes):
        self.zipped = content[:2] == b"\x1f\x8b"
        self.raw = gzip.decompress(content) if self.zipped else bytes(content)
        self.order = next((o for o in "<>" if struct.unpack_from(o + "i", self.raw)[0] in LAYOUT), None)
        if self.order is None:
            raise ValueError("not a NIfTI file")
        self.size = struct.unpack_from(self.order + "i", self.raw)[0]
        self.at = LAYOUT[self.size]
        dim = self._get("dim")
        self.shape = [int(n) for n in dim[1 : 1 + max(0, min(7, dim[0]))]]
        self.datatype, self.offset = self._get("datatype")[0], int(self._get("vox_offset")[0])

    def _get(self, field: str) -> tuple:
        place, kind = self.at[field]
        return struct.unpack_from(self.order + kind, self.raw, place)

    def text(self, field: str) -> str:
        place, n = self.at[field]
        return self.raw[place : place + n].split(b"\0", 1)[0].decode("latin-1")

    def extensions(self) -> list[bytes]:
        place, out = self.at["extension"], []
        if self.offset <= place + 4 or not self.raw[place : place + 1] == b"\x01":
            return out
        place += 4
        while place + 8 <= self.offset:
            size, _ = struct.unpack_from(self.order + "2i", self.raw, place)
            if size < 8:
                break
            out.append(self.raw[place + 8 : place + size])
            place += size
        return out

    def array(self) -> np.ndarray:
        n = int(np.prod(self.shape)) if self.shape else 0
        return np.frombuffer(self.raw, np.dtype(self.order + DTYPES[self.datatype]), n, self.offset).reshape(self.shape, order="F")

    def cleaned(self, array: np.ndarray | None = None) -> bytes:
        """The file with text fields blank and without extensions, its cells replaced if given."""
        place = self.at["extension"]
        head = bytearray(self.raw[:place])
        for field in TEXT_FIELDS:
            at, n = self.at[field]
            head[at : at + n] = bytes(n)
        at, kind = self.at["vox_offset"]
        struct.pack_into(self.order + kind, head, at, place + 4)
        data = self.raw[self.offset :] if array is None else np.asarray(array, np.dtype(self.order + DTYPES[self.datatype])).tobytes(order="F")
        out = bytes(head) + b"\0\0\0\0" + data
        return gzip.compress(out, mtime=0) if self.zipped else out


def made(array: np.ndarray, descrip: str = "", version: int = 1, zipped: bool = False) -> bytes:
    """A minimal file, for tests and fixtures."""
    size = {1: 348, 2: 540}[version]
    at, raw = LAYOUT[size], bytearray(size + 4)
    struct.pack_into("<i", raw, 0, size)
    place, kind = at["dim"]
    struct.pack_into("<" + kind, raw, place, *([array.ndim, *array.shape] + [1] * 7)[:8])
    code = next(k for k, v in DTYPES.items() if np.dtype(v) == array.dtype)
    struct.pack_into("<h", raw, at["datatype"][0], code)
    struct.pack_into("<" + at["vox_offset"][1], raw, at["vox_offset"][0], size + 4)
    text = descrip.encode("latin-1")[:80]
    raw[at["descrip"][0] : at["descrip"][0] + len(text)] = text
    out = bytes(raw) + array.tobytes(order="F")
    return gzip.compress(out, mtime=0) if zipped else out


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                v = Volume(content)
                rows.append((i, 1 if v.size == 348 else 2, v.shape, v.datatype, *(v.text(f) for f in TEXT_FIELDS), len(v.extensions()), None))
            except Exception as e:  # noqa: BLE001 - a file that can't be read is a row that says so
                rows.append((i, *[None] * 7, str(e) or type(e).__name__))
        kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], [x.split()[0] for x in HEADER.split(", ")])


def headers(files: DataFrame) -> DataFrame:
    """Header fields of files (file_id, content); error where a file can't be read."""
    return files.select("file_id", "content").mapInArrow(_headers, HEADER)


def cleaned(files: DataFrame) -> DataFrame:
    """file_id, content (null if unreadable), error: files without text fields and extensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for content in b.column(1).to_pylist():
                try:
                    out.append(Volume(content).cleaned())
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    out.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["file_id", "content", "error"])

    return files.select("file_id", "content").mapInArrow(run, "file_id string, content binary, error string")
