"""Project folders, what a complete bundle carries, and what this installation can do."""

from __future__ import annotations

import importlib.util
import json
import os
import re
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of a bundle, whether it needs them, and whether they are secret.
COMPONENTS = [
    ("package", True, False),
    ("catalog and profiles", True, False),
    ("name lists", True, False),
    ("Python environment", True, False),
    ("NER model", False, False),
    ("OCR binary", False, False),
    ("global keystore", False, True),
    ("signing keys", False, True),
]
OPTIONAL = {"presidio": "presidio_analyzer", "ner": "transformers", "ocr": "pytesseract", "deface": "torch", "pdf": "pypdfium2", "imaging": "PIL"}


class Projects:
    """Projects below a folder: each has its settings, profile copies, audit log and, if not the global ones,
    its own keystore and signing keys."""

    def __init__(self, root: str):
        self.root = root

    def folder(self, project_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", project_id or ""):
            raise ValueError("a project's id is letters, digits, dots, dashes and underscores")
        return os.path.join(self.root, "projects", project_id)

    def create(self, project_id: str, copy_from: str | None = None, **settings) -> dict:
        folder = self.folder(project_id)
        if os.path.exists(os.path.join(folder, "project.json")):
            raise FileExistsError(project_id)
        base = {k: v for k, v in self.get(copy_from).items() if k not in ("id", "created_at")} if copy_from else {"profile_id": "default", "keystore": "global", "signing": "global"}
        os.makedirs(folder, exist_ok=True)
        if copy_from and os.path.isdir(os.path.join(self.folder(copy_from), "profiles")):
            shutil.copytree(os.path.join(self.folder(copy_from), "profiles"), os.path.join(folder, "profiles"), dirs_exist_ok=True)
        doc = base | settings | {"id": project_id}
        with open(os.path.join(folder, "project.json"), "w", encoding="utf-8") as f:
            json.dump(doc, f, indent=2, sort_keys=True)
        return doc

    def get(self, project_id: str) -> dict:
        with open(os.path.join(self.folder(project_id), "project.json"), encoding="utf-8") as f:
            return json.load(f)

    def ids(self) -> list[str]:
        top = os.path.join(self.root, "projects")
        return sorted(p for p in (os.listdir(top) if os.path.isdir(top) else []) if os.path.exists(os.path.join(top, p, "project.json")))

    def keystore_path(self, project_id: str) -> str:
        own = self.get(project_id).get("keystore") == "project"
        return os.path.join(self.folder(project_id), "keystore.json") if own else os.path.join(self.root, "keystores", "global.json")

    def signing_folder(self, project_id: str) -> str:
        own = self.get(project_id).get("signing") == "project"
        return os.path.join(self.folder(project_id), "signing") if own else os.path.join(self.root, "signing")

    def audit_path(self, project_id: str | None = None) -> str:
        return os.path.join(self.folder(project_id), "audit_log.jsonl") if project_id else os.path.join(self.root, "audit", "audit_log.jsonl")


def components(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPONENTS, "component string, required boolean, secret boolean")


def capabilities(spark: SparkSession) -> DataFrame:
    """name, available of what works only where a library is installed; the rest always does."""
    rows = [(name, importlib.util.find_spec(module) is not None) for name, module in sorted(OPTIONAL.items())]
    return spark.createDataFrame([("deterministic layers", True), *rows], "name string, available boolean")


def pixel_info(elements: DataFrame) -> DataFrame:
    """file_id and the geometry of its pixels, a column each: an aggregate over few tags, not a pivot."""
    tags = {"rows": 0x00280010, "columns": 0x00280011, "frames": 0x00280008, "samples": 0x00280002, "bits": 0x00280100}
    value = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("value").try_cast("int")))
    top = elements.where(F.col("tag").isin(*tags.values(), 0x7FE00010) & (F.size("path") == 0))
    out = top.groupBy("file_id").agg(*[value(t).alias(n) for n, t in tags.items()], F.bool_or(F.col("tag") == 0x7FE00010).alias("has_pixels"))
    return out.withColumn("frames", F.coalesce("frames", F.lit(1))).withColumn("samples", F.coalesce("samples", F.lit(1)))


def effective_workers(keystore: Column | bool, asked: int) -> int:
    """As many as asked: the salt is read only and the crosswalk a table, so a keystore forces no single worker."""
    return max(1, asked)
