"""The pipeline's stages against plain versions, each on what the one before kept."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from veildeck.llm import common, langid, packing, secrets
from veildeck.llm.queries import tokenizer_path

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, token string, key long"
ITEM = "zebra quokka walrus heron osprey marten ferret badger weasel otter"


def given():
    rng = random.Random(31)
    words = {x: ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(150)] for x, letters in (("en", "etaoinshr"), ("de", "enisratüö"))}
    text = lambda x, n: " ".join(rng.choices(words[x], k=n))
    rows = [(k, text(x, 60), x) for k, x in enumerate(["en", "de"] * 20)]
    near = rows[0][1].split()
    near[30] = "changed"
    rows += [(100, rows[0][1], "en"), (101, " ".join(near), "en"), (102, f"{text('en', 20)} {ITEM.title()} {text('en', 20)}", "en"), (103, "ab cd " + text("de", 30), "de")]
    rows += [(104, "12 34 ... !", "en"), (105, None, None), (106, "", "de"), (107, text("en", 9000), "en"), (108, f"{text('en', 30)} password=hunter2hunter2 {text('en', 9)}", "en")]
    rows += [(2, rows[2][1], "en"), (None, text("de", 40), None), (None, None, "en"), (3, text("de", 50), "de")]
    return [(i, t, x, "s", len(t) if t is not None else None, "r", "t", 1) for i, t, x in rows]


def tables(spark, path, rows, items):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def plain_print(text):
    w = (text or "").encode().lower().split()
    grams = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    h = [int.from_bytes(xxhash.xxh3_128_digest(g, seed=42), "little") for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(128))


def plain_groups(rows):
    prints = [plain_print(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            d = prints[a] ^ prints[b]
            if d.bit_count() <= 24 and any((d >> 16 * k & 0xFFFF).bit_count() <= 1 for k in range(8)):
                x, y = group[a], group[b]
                group = [x if g == y else g for g in group]
    return [min((i for i, g in enumerate(group) if g == own), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0)) for own in sorted(set(group))]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_stages_against_plain_versions(spark, tmp_path):
    items = [(1, ITEM), (2, "ab cd"), (3, None), (4, "")]
    docs = tables(spark, tmp_path, given(), items)
    stages = dict(corpus_pipeline.STAGES)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    assert len(stages) == 5

    kept = stages["language"](spark, docs, str(tmp_path))
    judge = langid.Judge(langid.profiles(docs))
    rows = [r for r in docs.collect() if judge(r.text)[0] != "und" and judge(r.text)[1] >= corpus_pipeline.LEAST_SCORE]
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in rows} == {104, 105, 106}
    same(kept.collect(), rows)

    rows = kept.collect()
    kept = stages["near_duplicates"](spark, kept, str(tmp_path))
    want = [rows[k] for k in plain_groups(rows)]
    assert kept.columns == docs.columns and not {100, 101} & {r.doc_id for r in want}
    same(kept.collect(), want)

    rows = kept.collect()
    kept = stages["decontamination"](spark, kept, str(tmp_path))
    runs = lambda w: {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    want = [r for r in rows if not runs(split(r.text)) & runs(split(ITEM))]
    assert kept.columns == docs.columns and {102} == {r.doc_id for r in rows} - {r.doc_id for r in want}
    same(kept.collect(), want)

    rows = kept.collect()
    scanner = secrets.Scanner(secrets.ordinary_strings(kept))
    kept = stages["secrets"](spark, kept, str(tmp_path))
    clean = [secrets.redacted(r.text, scanner.spans(r.text)) for r in rows]
    same(kept.select("doc_id", "text", "n_chars").collect(), [(r.doc_id, t, len(t)) for r, t in zip(rows, clean, strict=True)])
    (left,) = kept.where("doc_id = 108").select("text").first()
    assert kept.columns == docs.columns and "hunter2" not in left and "<secret>" in left

    out = stages["packing"](spark, kept, str(tmp_path))
    encoder, whole = packing.Encoder(tokenizer_path()), {}
    for r in out.collect():
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    want = sorted(np.frombuffer(encoder.encode(r.text), "<u2").tolist() + [0] for r in kept.collect())
    assert sorted(sum((x for _, x in sorted(p)), []) for p in whole.values()) == want


@pytest.mark.parametrize("case", ["no documents", "no items", "nothing", "no labels", "null ids"])
def test_empty_tables_and_nulls(spark, tmp_path, case):
    rows, items = given(), [(1, ITEM)]
    if case in ("no documents", "nothing"):
        rows = []
    if case in ("no items", "nothing"):
        items = []
    if case == "no labels":
        rows = [(i, t, None, *rest) for i, t, _, *rest in rows]
    if case == "null ids":
        rows = [(None, *rest) for _, *rest in rows]
    tables(spark, tmp_path, rows, items)
    out = corpus_pipeline.run(spark, str(tmp_path))
    if not rows:
        assert out.count() == 0
    else:
        assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    if case == "no labels":
        assert {r.doc_id for r in out.select("doc_id").collect()} >= set(range(1, 40))


def test_stages_begin_with_room(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path, given(), [(1, ITEM)])
    order = []
    monkeypatch.setattr(corpus_pipeline, "ready", lambda _: order.append("ready"))
    stage = lambda name, f: lambda *a: (order.append(name), f(*a))[1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, stage(name, f)) for name, f in corpus_pipeline.STAGES])
    corpus_pipeline.run(spark, str(tmp_path))
    assert order == [x for name, _ in corpus_pipeline.STAGES for x in (name, "ready")]


def test_room(spark, monkeypatch):
    collected = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName())
    before = collected()
    common.give_back(spark, 2)
    assert collected() > before

    docs = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("some words "), 200).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    spark.conf.unset(common.BATCH_SETTING)
    common.ready(spark)
    found = [r.n for r in docs.mapInArrow(common.lean(sizes), "n long").collect()]
    assert sum(found) > 8_000_000 and max(found) < 2 * common.BATCH_BYTES
    spark.conf.set(common.BATCH_SETTING, "4m")  # the session's own setting stays
    common.ready(spark)
    assert spark.conf.get(common.BATCH_SETTING) == "4m"
    spark.conf.unset(common.BATCH_SETTING)


def test_workers_give_freed_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.lean(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4] and calls == [1]
    rows = common.lean(lambda batches: (b for b in batches))([1, 2])
    assert next(rows) == 1 and calls == [1]
    rows.close()  # a task that ends early
    assert calls == [1, 1]
