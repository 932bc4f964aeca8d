"""A source of elements from DICOM Part 10 files, as long rows; their frames; and a writer.

Explicit and implicit little endian, big endian and deflated files are read, of any kind of pixels. Nested
sequences become paths. Files that can't be read give one row with skipped. Compressed pixels are kept as
bytes; frames are decoded if they are raw or run-length coded. Registered with Spark as format `dicom_elements`.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans import catalog as C

# Fixed values of the format.
LONG_VRS = frozenset("OB OD OF OL OV OW SQ UC UN UR UT SV UV".split())
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "SV": "q", "UV": "Q"}
ITEM, ITEM_END, SEQUENCE_END, UNDEFINED = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFFFFFF
IMPLICIT, EXPLICIT, BIG_ENDIAN, DEFLATED, RUN_LENGTH = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.5"
SCHEMA = "file_id string, path array<struct<tag:long,item:int>>, ord int, tag long, vr string, value string, values array<string>, value_bin binary, skipped string"


@functools.cache
def _vrs() -> dict[int, str]:
    return {t: v for t, _, v in C.dictionary()}


class Parser:
    """The tree of a file: nodes (tag, vr, value), where value is little-endian bytes, a list of items (lists of
    nodes), or Fragments. Big-endian and deflated files are put right as they are read."""

    def __init__(self, raw: bytes):
        if raw[128:132] != b"DICM":
            raise ValueError("no DICM mark")
        self.raw, self.order, self.vrs = raw, "<", _vrs()
        self.meta: list[tuple] = []
        end, self.syntax = self._meta()
        if self.syntax == DEFLATED:
            self.raw, end = zlib.decompressobj(-15).decompress(raw[end:]), 0
        if self.syntax == BIG_ENDIAN:
            self.order = ">"
        _, self.nodes = self._elements(end, len(self.raw), self.syntax == IMPLICIT)

    def _meta(self) -> tuple[int, str]:
        at, syntax = 132, EXPLICIT
        while at + 8 <= len(self.raw) and struct.unpack_from("<H", self.raw, at)[0] == 2:
            tag, vr, start, size = self._head(at, False)
            value = self.raw[start : start + size]
            self.meta.append((tag, vr, value))
            if tag == 0x00020010:
                syntax = value.rstrip(b"\0 ").decode("ascii", "replace")
            at = start + size
        return at, syntax

    def _head(self, at: int, implicit: bool) -> tuple[int, str, int, int]:
        o = self.order
        group, element = struct.unpack_from(f"{o}HH", self.raw, at)
        tag = group << 16 | element
        if implicit or tag in (ITEM, ITEM_END, SEQUENCE_END):
            return tag, self.vrs.get(tag, "UN"), at + 8, struct.unpack_from(f"{o}I", self.raw, at + 4)[0]
        vr = self.raw[at + 4 : at + 6].decode("ascii", "replace")
        if vr in LONG_VRS:
            return tag, vr, at + 12, struct.unpack_from(f"{o}I", self.raw, at + 8)[0]
        return tag, vr, at + 8, struct.unpack_from(f"{o}H", self.raw, at + 6)[0]

    def _elements(self, at: int, end: int, implicit: bool) -> tuple[int, list]:
        nodes: list[tuple] = []
        while at + 8 <= end:
            tag, vr, start, size = self._head(at, implicit)
            if tag == ITEM_END:
                return start, nodes
            if vr == "SQ" or vr == "UN" and size == UNDEFINED:
                at, items = self._items(start, end if size == UNDEFINED else start + size, implicit)
                nodes.append((tag, "SQ", items))
            elif size == UNDEFINED:  # compressed pixels
                at, parts = start, Fragments()
                while at + 8 <= end:
                    inner, _, s, n = self._head(at, True)
                    at = s + (0 if n == UNDEFINED else n)
                    if inner == SEQUENCE_END:
                        break
                    parts.append(self.raw[s:at])
                nodes.append((tag, vr, parts))
            else:
                if start + size > len(self.raw):
                    raise ValueError("the file ends within an element")
                value = self.raw[start : start + size]
                nodes.append((tag, vr, _swapped(vr, value) if self.order == ">" else value))
                at = start + size
        return at, nodes

    def _items(self, at: int, end: int, implicit: bool) -> tuple[int, list]:
        items = []
        while at + 8 <= end:
            inner, _, start, size = self._head(at, True)
            if inner == SEQUENCE_END:
                return start, items
            if inner != ITEM:
                raise ValueError("an item was expected")
            at, nodes = self._elements(start, end if size == UNDEFINED else start + size, implicit)
            items.append(nodes)
        return at, items

    def value(self, tag: int):
        return next((v for t, _, v in self.nodes if t == tag), None)

    def number(self, tag: int, default: int) -> int:
        """Of a US or an IS element at the top."""
        found = next(((r, v) for t, r, v in self.nodes if t == tag), None)
        if found is None or not found[1]:
            return default
        return struct.unpack_from("<H", found[1])[0] if found[0] == "US" or len(found[1]) == 2 and not found[1].strip(b" \0").isdigit() else int(found[1].strip(b" \0").split(b"\\")[0])


class Fragments(list):
    """The parts of compressed pixels, the table of offsets first."""


def _swapped(vr: str, value: bytes) -> bytes:
    width = struct.calcsize(NUMBERS[vr]) if vr in NUMBERS else {"AT": 2, "OW": 2, "OF": 4, "OL": 4, "OD": 8, "OV": 8}.get(vr, 1)
    return b"".join(value[k : k + width][::-1] for k in range(0, len(value), width)) if width > 1 else value


def _value(vr: str, x: bytes) -> tuple:
    if vr in C.BULK_VRS or vr in ("OL", "OV"):
        return None, [], x
    if vr in NUMBERS:
        size = struct.calcsize(NUMBERS[vr])
        got = [str(v) for v in struct.unpack(f"<{len(x) // size}{NUMBERS[vr]}", x[: len(x) // size * size])]
    elif vr == "AT":
        got = [f"({a:04X},{b:04X})" for a, b in struct.iter_unpack("<HH", x[: len(x) // 4 * 4])]
    else:
        text = x.rstrip(b"\0 ").decode("utf-8", "replace") if vr != "UI" else x.rstrip(b"\0").decode("ascii", "replace")
        got = [text] if vr in ("ST", "LT", "UT", "UR") else text.split("\\")
    return "\\".join(got), got if len(got) > 1 else [], None


def _rows(nodes: list, path: list) -> list[tuple]:
    rows = []
    for order, (tag, vr, value) in enumerate(nodes):
        if isinstance(value, Fragments):
            rows.append((path, order, tag, vr, None, [], b"".join(value)))
        elif isinstance(value, list):
            rows.append((path, order, tag, "SQ", str(len(value)), [], None))
            for k, item in enumerate(value):
                rows += _rows(item, [*path, {"tag": tag, "item": k}])
        else:
            rows.append((path, order, tag, vr, *_value(vr, value)))
    return rows


def parsed(file_id: str, raw: bytes) -> list[tuple]:
    try:
        return [(file_id, *row, None) for row in _rows(Parser(raw).nodes, [])]
    except Exception as e:  # noqa: BLE001 - a file that can't be read is a row that says so
        return [(file_id, [], 0, None, None, None, [], None, str(e) or type(e).__name__)]


# --- pixels

ROWS, COLUMNS, SAMPLES, PLANAR, BITS, SIGNED, N_FRAMES, PIXELS = 0x00280010, 0x00280011, 0x00280002, 0x00280006, 0x00280100, 0x00280103, 0x00280008, 0x7FE00010


def _unpacked(data: bytes) -> bytes:
    """Of run lengths: a count and so many bytes, or a negative count and one byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _run_length_frame(part: bytes, h: int, w: int, c: int, width: int) -> np.ndarray:
    """Segments hold one byte of each sample, the most significant first."""
    n, *offsets = struct.unpack_from("<16I", part)
    if n != c * width:
        raise ValueError(f"{n} segments for {c} samples of {width} bytes")
    ends = [*offsets[1:n], len(part)]
    planes = [np.frombuffer(_unpacked(part[a:b])[: h * w].ljust(h * w, b"\0"), np.uint8) for a, b in zip(offsets[:n], ends, strict=True)]
    out = np.zeros((h * w, c, width), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k // width, width - 1 - k % width] = plane
    return out.reshape(h, w, c * width)


def pixel_arrays(raw: bytes) -> list[np.ndarray]:
    """The frames of a file, (h, w, c) each; decoded if they are raw or run-length coded."""
    p = Parser(raw)
    h, w, c = p.number(ROWS, 0), p.number(COLUMNS, 0), p.number(SAMPLES, 1)
    bits, n, data = p.number(BITS, 8), p.number(N_FRAMES, 1), p.value(PIXELS)
    if data is None:
        raise ValueError("no pixels")
    dtype = np.dtype(f"<{'i' if p.number(SIGNED, 0) else 'u'}{bits // 8}")
    if isinstance(data, Fragments):
        if p.syntax != RUN_LENGTH:
            raise ValueError(f"no decoder for {p.syntax}")
        parts = [x for x in data[1:] if x]
        if len(parts) != n:
            raise ValueError(f"{len(parts)} fragments for {n} frames")
        return [_run_length_frame(x, h, w, c, bits // 8).reshape(-1).view(dtype).reshape(h, w, c) for x in parts]
    whole = np.frombuffer(data, dtype, n * h * w * c).reshape(n, c, h, w) if c > 1 and p.number(PLANAR, 0) == 1 else np.frombuffer(data, dtype, n * h * w * c).reshape(n, h, w, c)
    return list(whole.transpose(0, 2, 3, 1) if c > 1 and p.number(PLANAR, 0) == 1 else whole)


FRAME_ROWS = "file_id string, frame int, h int, w int, c int, dtype string, data binary, skipped string"


def frames(files):
    """A row for each frame of files (file_id, content); for a file whose pixels can't be decoded one that says
    why. A batch holds one frame."""
    import pyarrow as pa

    schema = pa.schema([("file_id", pa.string()), *[(x, pa.int32()) for x in ("frame", "h", "w", "c")], ("dtype", pa.string()), ("data", pa.binary()), ("skipped", pa.string())])

    def run(batches):
        for b in batches:
            for i, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = pixel_arrays(content or b"")
                except Exception as e:  # noqa: BLE001
                    yield pa.RecordBatch.from_pylist([{"file_id": i, "skipped": str(e) or type(e).__name__}], schema)
                    continue
                for k, a in enumerate(found):
                    yield pa.RecordBatch.from_pylist([{"file_id": i, "frame": k, "h": a.shape[0], "w": a.shape[1], "c": a.shape[2], "dtype": a.dtype.str, "data": a.tobytes()}], schema)

    return files.select("file_id", "content").mapInArrow(run, FRAME_ROWS)


# --- writing


def _element(tag: int, vr: str, value: bytes) -> bytes:
    if len(value) % 2:
        value += b"\0" if vr in ("UI", "OB", "UN") else b" "
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr.encode()
    return head + (struct.pack("<HI", 0, len(value)) if vr in LONG_VRS else struct.pack("<H", len(value))) + value


def _tree(nodes: list) -> bytes:
    out = b""
    for tag, vr, value in sorted(nodes, key=lambda n: n[0]):
        if isinstance(value, Fragments):
            parts = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x for x in value)
            out += struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr.encode() + struct.pack("<HI", 0, UNDEFINED) + parts + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
        elif isinstance(value, list):
            out += _element(tag, "SQ", b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(x)) + x for x in map(_tree, value)))
        else:
            out += _element(tag, vr, value)
    return out


def file_of(nodes: list, syntax: str = EXPLICIT, meta: list | None = None) -> bytes:
    """A whole file in explicit little endian; its meta elements follow the record's own identifiers."""
    kept = {t: (t, r, v) for t, r, v in meta or [] if t not in (0x00020000, 0x00020010)}
    kept[0x00020010] = (0x00020010, "UI", syntax.encode())
    for own, there in ((0x00020002, 0x00080016), (0x00020003, 0x00080018)):
        if value := next((v for t, _, v in nodes if t == there), None):
            kept[own] = (own, "UI", value)
    body = b"".join(_element(*kept[t]) for t in sorted(kept))
    return bytes(128) + b"DICM" + _element(0x00020000, "UL", struct.pack("<I", len(body))) + body + _tree(nodes)


def with_pixels(raw: bytes, found: list[np.ndarray]) -> bytes:
    """The file with other frames, uncompressed in explicit little endian."""
    p = Parser(raw)
    changed = {PIXELS: ("OW" if found[0].dtype.itemsize > 1 else "OB", b"".join(np.ascontiguousarray(a).tobytes() for a in found))}
    if len(found) > 1:
        changed[N_FRAMES] = ("IS", str(len(found)).encode())
    if found[0].shape[-1] == 3:
        changed[PLANAR] = ("US", struct.pack("<H", 0))
    nodes = [n for n in p.nodes if n[0] not in changed] + [(t, r, v) for t, (r, v) in changed.items()]
    return file_of(nodes, EXPLICIT, p.meta)


def rewritten(raw: bytes, changes: dict[tuple, str | None]) -> bytes:
    """The file with elements changed (a new value) or removed (None), by their path: tags and item numbers in
    turn, the element's own tag last. Values that no element of the file has are added at the top."""
    p = Parser(raw)

    def walk(nodes: list, path: tuple) -> list:
        out = []
        for tag, vr, value in nodes:
            here = (*path, tag)
            if here in changes:
                if changes[here] is not None:
                    out.append((tag, vr, value if isinstance(value, list) else changes[here].encode()))
            elif isinstance(value, list) and not isinstance(value, Fragments):
                out.append((tag, vr, [walk(item, (*here, k)) for k, item in enumerate(value)]))
            else:
                out.append((tag, vr, value))
        return out

    nodes = walk(p.nodes, ())
    have = {t for t, _, _ in nodes}
    nodes += [(path[0], p.vrs.get(path[0], "LO"), v.encode()) for path, v in changes.items() if len(path) == 1 and v is not None and path[0] not in have]
    compressed = any(isinstance(v, Fragments) for _, _, v in nodes)
    return file_of(nodes, p.syntax if compressed else EXPLICIT, p.meta)


def rewritten_files(files, changes):
    """file_id and content of files (file_id, content) with changes (file_id, path, tag, result, removed) put in;
    content is null and error set where a file can't be read. Elements that don't change need no row."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    per = changes.groupBy("file_id").agg(F.collect_list(F.struct("path", "tag", "result", "removed")).alias("changes"))

    def one(content: bytes, rows: list[dict]) -> tuple[bytes | None, str | None]:
        try:
            what = {(*(x for p in r["path"] or [] for x in (p["tag"], p["item"])), r["tag"]): None if r["removed"] else r["result"] or "" for r in rows or []}
            return rewritten(content or b"", what), None
        except Exception as e:  # noqa: BLE001
            return None, str(e) or type(e).__name__

    def run(batches):
        for b in batches:
            found = [one(c, r) for c, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in found], pa.binary()), pa.array([e for _, e in found], pa.string())], ["file_id", "content", "error"])

    return files.join(per, "file_id", "left").select("file_id", "content", "changes").mapInArrow(run, "file_id string, content binary, error string")


def encoded(rows: list[tuple], syntax: str = EXPLICIT) -> bytes:
    """An explicit little-endian file of elements (tag, vr, value): text or bytes, or a list of items."""
    raw = lambda v: v if isinstance(v, Fragments) else [[(t, r, raw(x)) for t, r, x in item] for item in v] if isinstance(v, list) else v.encode() if isinstance(v, str) else v
    return file_of([(t, r, raw(v)) for t, r, v in rows], syntax)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, per_task: int):
        self.root, self.per_task = root, per_task

    def partitions(self) -> list[InputPartition]:
        found = [self.root] if os.path.isfile(self.root) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.root) for f in fs)
        return [_Files(found[k : k + self.per_task]) for k in range(0, len(found), self.per_task)] or [_Files([])]

    def read(self, partition: _Files):
        for path in partition.paths:
            with open(path, "rb") as f:
                yield from parsed(path, f.read())


class DicomElements(DataSource):
    """format("dicom_elements").load(folder): a folder that all executors see; for object stores use
    elements(), which reads through Spark."""

    @classmethod
    def name(cls) -> str:
        return "dicom_elements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://"), int(self.options.get("filesPerTask", 64)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DicomElements)


#: Elements, and bytes of files, from which on a batch is put out: small files share one, as each costs a millisecond.
MOST_ROWS, MOST_BYTES = 8192, 4 << 20


def elements(files):
    """Elements of files (file_id, content), such as binaryFile gives them, from any store."""
    import pyarrow as pa

    kinds = [pa.string(), pa.list_(pa.struct([("tag", pa.int64()), ("item", pa.int32())])), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.string()]
    names = ["file_id", "path", "ord", "tag", "vr", "value", "values", "value_bin", "skipped"]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for i, content in zip(b.column(0), b.column(1), strict=True):
                raw = content.as_py() or b""
                rows += parsed(i.as_py(), raw)
                size += len(raw)
                if len(rows) >= MOST_ROWS or size >= MOST_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return files.select("file_id", "content").mapInArrow(run, SCHEMA)
