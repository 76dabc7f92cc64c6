"""The line field against enumeration, and its held-out accuracy."""

import itertools
import zlib

import numpy as np

from laneguard.llm.quality import marginals, score_quality
from laneguard.llm.queries import QUERIES

from .rows import hard_docs, no_docs


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    counts = np.array([1, 4, 0, 6, 3, 6])
    odds, turns = r.normal(size=counts.sum()) * 2, r.normal(size=(2, 2))
    pairs = np.zeros((2, 2))
    got = marginals(odds, counts, turns, pairs)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in counts:
        if not n:
            continue
        total, good, turned = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(odds[at + i] * y[i] for i in range(n)) + sum(turns[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:]):
                turned[a, b] += w
        assert np.allclose(got[at:at + n], good / total)
        want_pairs += turned / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(y, got[i]["predicted"]) for i, y in labels.items() if got[i]["held_out"]]
    good, bad = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(good) >= 0.95 * len(good) and sum(good) + len(bad) - sum(bad) >= 0.95 * len(held)


def test_hard_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 0), (3, 7, 0), (None, 1, 0), (0, 1, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    docs = hard_docs(spark)
    out = score_quality(docs, labels)
    rows = out.collect()
    assert out.columns == [*docs.columns, "score", "predicted"] and len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] == 100} == {r["score"] for r in rows if r["doc_id"] == 101}
    assert all(r["score"] == 0.5 for r in score_quality(docs, labels.limit(0)).collect())
    assert score_quality(no_docs(spark), labels).count() == 0
