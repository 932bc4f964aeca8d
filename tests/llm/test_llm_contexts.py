"""Contexts of more than two bytes, against the definition."""

import math
from collections import Counter

import numpy as np
import pytest

from veildeck.llm import common, ppm, queries

TEXTS = ["the cat sat on the mat", "the cat ran", "", None, "éa then the thing", "a catalogue of the matter", "the cat sat on the hat", "zzzz the cat qqq"]


def plain(texts, order):
    by = [{} for _ in range(order + 1)]
    for t in texts:
        x = b"\xff" * order + t + b"\xff"
        for k in range(order, len(x)):
            for n in range(order + 1):
                by[n].setdefault(x[k - n : k], Counter())[x[k]] += 1

    def p(context, symbol, n, gone=frozenset()):
        if n < 0:
            return 1 / (256 - len(gone))
        seen = {s: v for s, v in by[n].get(context[len(context) - n :], {}).items() if s not in gone}
        if not seen:
            return p(context, symbol, n - 1, gone)
        total, escape = sum(seen.values()), 0 if len(gone | seen.keys()) == 256 else len(seen)
        return seen[symbol] / (total + escape) if symbol in seen else escape / (total + escape) * p(context, symbol, n - 1, gone | seen.keys())

    return p


@pytest.mark.parametrize("order", [3, 4, 5])
def test_scores_of_longer_contexts(spark, order):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(24)] + [(None, "the cat"), (3, "the cat"), (3, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    p = plain([(t or "").encode() for i, t in rows if not ppm.held_out(i)], order)
    want = []
    for i, t in rows:
        b = b"\xff" * order + (t or "").encode() + b"\xff"
        want.append((i is None, i or 0, round(sum(math.log10(p(b[k - order : k], b[k], order)) for k in range(order, len(b))), 3)))
    got = [(r.doc_id is None, r.doc_id or 0, round(r.score, 3)) for r in ppm.scored(docs, order).collect()]
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in sorted(got)] == pytest.approx([x[2] for x in sorted(want)], abs=2e-3)


def test_query_uses_contexts_beyond_the_broadcast_ones():
    assert queries.LM_ORDER > ppm.LOW


def test_order_two_is_the_trie():
    texts = [b"abracadabra", b"", b"abc" * 5, bytes(range(255)) * 3]
    at, _ = ppm.codes(texts)
    low = tuple(x.astype(np.int64) for x in np.unique(at, return_counts=True))
    code, n = np.unique(ppm.long_codes(texts, 2)[0], return_counts=True)
    old = (code >> 8 & 0xFF) << 16 | (code >> 16) << 8 | code & 0xFF
    assert ppm.log_probabilities(code, n, low, 2) == pytest.approx(ppm.log_table(*low)[old].astype(float), abs=1e-5)


def test_dealt_rows_are_not_sorted(spark):
    rows = [(k % 3, k) for k in range(100)] + [(None, 100)]
    before = spark.conf.get(common.OPEN_SETTING)
    done = spark._jsparkSession.sharedState().statusStore()
    found, path = common.dealt(spark.createDataFrame(rows, "kind int, n long").repartition(2), "test", "kind")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plan = done.executionsList().apply(done.executionsCount() - 1).physicalPlanDescription()
    assert "WriteFiles" in plan and "Sort (" not in plan and spark.conf.get(common.OPEN_SETTING) == before
    assert sorted(map(tuple, found.select("kind", "n").collect()), key=repr) == sorted(rows, key=repr)
    common.drop_part(spark, path, "kind", 1)
    assert spark.read.parquet(path).count() == 101 - 33


def test_scoring_makes_room_before_each_python_stage(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(ppm, "ready", lambda _: steps.append("ready"))
    for name in ("trained", "dealt", "written"):
        monkeypatch.setattr(ppm, name, lambda *a, f=getattr(ppm, name): (steps.append(a[1] if len(a) > 1 else "trained"), f(*a))[1])
    docs = spark.createDataFrame([(1, "the cat"), (2, "the hat")], "doc_id long, text string")
    assert ppm.scored(docs, 4).count() == 2
    assert steps == ["ready", "trained", "postings", "counts", "back", "ready", "logs", "ready"]
