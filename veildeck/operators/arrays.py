"""Pixels and volumes: frames as rows, boxes, scaling, gates, dilation, defacing.

Long form is a row for each cell (file_id, frame or z, y, x, v); frame form is a row for each frame with its
bytes, rewritten in Arrow batches, so that memory holds single frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAMES = "file_id string, frame int, h int, w int, c int, dtype string, data binary"
CT_FLOOR, CT_QUANTILE = -300.0, 0.01
LEAST_SLICES, LEAST_BORDER, HEAD_FRACTION = 16, 0.7, (0.02, 0.6)


def filled(cells: DataFrame, boxes: DataFrame, fill: float = 0) -> DataFrame:
    """cells with v set within boxes (file_id, frame or null for all, x, y, w, h).

    Boxes are joined by file; those of a file are few and are tested in place, so cells aren't multiplied."""
    per = boxes.where("w > 0 and h > 0").select("file_id", F.struct("frame", F.greatest("x", F.lit(0)).alias("x"), F.greatest("y", F.lit(0)).alias("y"), "w", "h").alias("b")).groupBy("file_id").agg(F.collect_set("b").alias("boxes"))
    rows = cells.join(per, "file_id", "left")
    inside = F.exists("boxes", lambda b: (b["frame"].isNull() | (b["frame"] == F.col("frame"))) & (F.col("x") >= b["x"]) & (F.col("x") < b["x"] + b["w"]) & (F.col("y") >= b["y"]) & (F.col("y") < b["y"] + b["h"]))
    return rows.withColumn("v", F.when(F.coalesce(inside, F.lit(False)), F.lit(fill).cast("double")).otherwise(F.col("v"))).select(*cells.columns)


def filled_frames(frames: DataFrame, boxes: DataFrame, fill: float = 0) -> DataFrame:
    """The same on frames' bytes; clamped to the image."""
    per = boxes.select("file_id", F.struct("frame", "x", "y", "w", "h").alias("b")).groupBy("file_id").agg(F.collect_set("b").alias("boxes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                a = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"], r["c"]).copy()
                for x in r["boxes"] or []:
                    if x["frame"] is None or x["frame"] == r["frame"]:
                        x0, y0 = max(0, x["x"]), max(0, x["y"])
                        a[y0 : max(y0, y0 + x["h"]), x0 : max(x0, x0 + x["w"])] = fill
                out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(6)), pa.array(out, pa.binary())], [x.split()[0] for x in FRAMES.split(", ")])

    return frames.join(per, "file_id", "left").select("file_id", "frame", "h", "w", "c", "dtype", "data", "boxes").mapInArrow(run, FRAMES)


def to_frames(file_id: str, array: np.ndarray, n_frames: int = 1) -> list[tuple]:
    """Rows of an array of (h, w), (h, w, c), (n, h, w) or (n, h, w, c)."""
    a = np.asarray(array)
    if n_frames == 1 and (a.ndim == 2 or a.ndim == 3 and a.shape[-1] in (3, 4)):
        a = a[None]
    if a.ndim == 3:
        a = a[..., None]
    return [(file_id, k, *f.shape, f.dtype.str, f.tobytes()) for k, f in enumerate(a)]


def scaled(cells: DataFrame, by: list[str]) -> DataFrame:
    """v in 0 to 255 between each frame's least and largest value; 0 where they are equal."""
    ends = cells.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    new = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255))
    return cells.join(ends, by).withColumn("v", new.cast("int")).select(*cells.columns)


def looks_like_ct(cells: DataFrame) -> DataFrame:
    """file_id, is_ct: a hundredth of the values lies far below zero, as air does in CT numbers."""
    return cells.groupBy("file_id").agg((F.percentile("v", CT_QUANTILE) < CT_FLOOR).alias("is_ct"))


def head_inclusive(cells: DataFrame) -> DataFrame:
    """file_id, is_head of volumes (z, y, x, v): enough slices, an empty border, a compact foreground."""
    size = cells.groupBy("file_id").agg(F.avg("v").alias("mean"), *[(F.max(a) + 1).alias(f"n_{a}") for a in "zyx"])
    least = F.least("n_z", "n_y", "n_x")
    axis = F.when(F.col("n_z") == least, F.col("z")).when(F.col("n_y") == least, F.col("y")).otherwise(F.col("x"))
    rows = cells.join(size, "file_id").withColumn("fg", (F.col("v") > F.col("mean")).cast("double")).withColumn("end", (axis == 0) | (axis == least - 1)).withColumn("least", least)
    sums = rows.groupBy("file_id").agg(F.max("least").alias("least"), F.avg("fg").alias("fraction"), F.avg(F.when(F.col("end"), F.col("fg"))).alias("border"))
    low, high = HEAD_FRACTION
    return sums.select("file_id", ((F.col("least") >= LEAST_SLICES) & (F.col("fraction") > 0) & (1 - F.col("border") > LEAST_BORDER) & (F.col("fraction") > low) & (F.col("fraction") < high)).alias("is_head"))


def dilated(mask: DataFrame, sizes: DataFrame, times: int = 1) -> DataFrame:
    """mask (file_id, z, y, x) grown by the six neighbours, within sizes (file_id, n_z, n_y, n_x)."""
    steps = F.array(*[F.struct(*[F.lit(s).alias(a) for a, s in zip("zyx", d, strict=True)]) for d in [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]])
    for _ in range(times):
        near = mask.select("file_id", F.explode(F.transform(steps, lambda d: F.struct(*[(F.col(a) + d[a]).alias(a) for a in "zyx"]))).alias("p")).select("file_id", "p.*").distinct()
        mask = near.join(sizes, "file_id").where("z between 0 and n_z - 1 and y between 0 and n_y - 1 and x between 0 and n_x - 1").select("file_id", "z", "y", "x")
    return mask


def defaced(cells: DataFrame, modality: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, margin: int = 2) -> tuple[DataFrame, DataFrame]:
    """Volumes without their faces, and what was done to each: file_id, defaced, reason.

    model gives the cells of faces (file_id, z, y, x) of the volumes that pass the gates; without one they
    stay as they are, and say so. modality has file_id and modality (null: judged by the values)."""
    gates = head_inclusive(cells).join(looks_like_ct(cells), "file_id").join(modality, "file_id", "left")
    ct = F.when(F.col("modality").isNotNull(), F.upper("modality") == "CT").otherwise(F.col("is_ct"))
    state = F.when(~F.col("is_head"), "no-head-fov").when(ct, "head-inclusive non-MR").when(F.lit(model is None), "deface model unavailable").otherwise("")
    plan = gates.select("file_id", (state == "").alias("defaced"), state.alias("reason"))
    if model is None:
        return cells, plan
    sizes = cells.groupBy("file_id").agg(*[(F.max(a) + 1).alias(f"n_{a}") for a in "zyx"])
    mask = dilated(model(cells.join(plan.where("defaced"), "file_id", "left_semi")), sizes, margin).withColumn("gone", F.lit(True))
    out = cells.join(mask, ["file_id", "z", "y", "x"], "left").withColumn("v", F.when(F.col("gone"), 0.0).otherwise(F.col("v"))).select(*cells.columns)
    return out, plan


def redacted_pixels(files: DataFrame, boxes: DataFrame, fill: float = 0) -> DataFrame:
    """file_id, content, frames, boxes, decompressed and error of files (file_id, content) with boxes (file_id,
    frame or null, x, y, w, h) filled: decoded, filled, stored uncompressed. What can't be decoded has no content."""
    from ..sources import dicom

    per = boxes.groupBy("file_id").agg(F.collect_list(F.struct("frame", "x", "y", "w", "h")).alias("boxes"))

    def one(content: bytes, found: list[dict]) -> tuple:
        try:
            frames = [a.copy() for a in dicom.pixel_arrays(content)]
            for b in found:
                x0, y0 = max(0, b["x"]), max(0, b["y"])
                for k, a in enumerate(frames):
                    if b["frame"] in (None, k):
                        a[y0 : max(y0, y0 + b["h"]), x0 : max(x0, x0 + b["w"])] = fill
            packed = isinstance(dicom.Parser(content).value(dicom.PIXELS), dicom.Fragments)
            return dicom.with_pixels(content, frames), len(frames), len(found), packed, None
        except Exception as e:  # noqa: BLE001 - a file that can't be decoded is a row that says so
            return None, None, None, None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = one(b.column(1)[k].as_py() or b"", b.column(2)[k].as_py() or [])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *[pa.array([v], kind) for v, kind in zip(row, (pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.string()), strict=True)]], ["file_id", "content", "frames", "boxes", "decompressed", "error"])

    return files.join(per, "file_id", "left").select("file_id", "content", "boxes").mapInArrow(run, "file_id string, content binary, frames int, boxes int, decompressed boolean, error string")
