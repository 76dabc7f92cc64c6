"""Substring dedup against brute force and SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from laneguard.llm.queries import QUERIES
from laneguard.llm.registry import CHECKS
from laneguard.llm.substring import Automaton, remove_repeats

from .rows import hard_docs, no_docs


def texts():
    r = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    shared = [[r.choice(words) for _ in range(n)] for n in (13, 14, 30, 60, 12)]
    out = []
    for _ in range(70):
        w = []
        for _ in range(r.randint(1, 4)):
            w += r.choice(shared) if r.random() < 0.5 else r.choices(words, k=r.randint(1, 25))
        if r.random() < 0.2:
            w = ["a", "b"] * r.randint(5, 30)
        out.append(" ".join(w))
    return out + out[3:6] + ["same " * 40, "same " * 41]


@pytest.mark.parametrize("shard", [4000, 3])
def test_remove_repeats(spark, monkeypatch, shard):
    monkeypatch.setattr("laneguard.llm.substring.SHARD_STRETCHES", shard)
    df = hard_docs(spark, texts())
    rows = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect()]
    first = {}
    for doc, w in rows:
        if doc is not None:
            for i in range(len(w) - 12):
                g = tuple(w[i:i + 13])
                first[g] = min(first.get(g, doc), doc)
    want = []
    for doc, w in rows:
        gone = set()
        for i in range(len(w) - 12):
            if doc is not None and first[tuple(w[i:i + 13])] < doc:
                gone |= set(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    got = [tuple(r) for r in remove_repeats(df).drop("kept").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(n for _, _, n, _ in want) > 500
    assert remove_repeats(no_docs(spark)).count() == 0


def test_automaton_reports_the_smallest_document():
    r = random.Random(1)
    seqs = [[r.choice("abc") for _ in range(r.randint(3, 30))] for _ in range(30)]
    a = Automaton()
    for i, s in enumerate(seqs):
        a.add(s, (i * 7) % 30)
    a.close()
    for s in seqs:
        want = [min((j * 7) % 30 for j, t in enumerate(seqs) if s[i:i + 4] in [t[k:k + 4] for k in range(len(t) - 3)]) for i in range(len(s) - 3)]
        assert a.earliest(s, 4) == want


def test_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.execute(CHECKS["op8_remove_repeats"])
    cols = [c[0] for c in rel.description]
    want = sorted(rel.fetchall())
    assert sorted(tuple(r) for r in QUERIES["op8_remove_repeats"](spark, sf_dir).select(*cols).collect()) == want and want


def test_automata_stay_small_under_a_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr("laneguard.llm.substring.SHARD_STRETCHES", 20)
    limit = 20 * 20

    class Bounded(Automaton):  # a local class, so that it is sent to the workers
        def add(self, words, doc):
            self.words = getattr(self, "words", 0) + len(words)
            if self.words > 2 * limit:
                raise AssertionError("automaton over its bound")
            Automaton.add(self, words, doc)
    monkeypatch.setattr("laneguard.llm.substring.Automaton", Bounded)
    r = random.Random(3)
    phrase = [f"p{i}" for i in range(7)]
    draw = lambda n: [f"v{r.randrange(10 ** 6)}" for _ in range(n)]
    tails = [draw(9) for _ in range(5)]
    # one phrase with other neighbours in every text, some of them followed alike
    texts = [draw(9) + phrase + (r.choice(tails) if i % 3 == 0 else draw(9)) for i in range(300)] + [["same"] * 900, ["same"] * 950]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    first = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 12):
            first.setdefault(tuple(t[j:j + 13]), i)
    want = {i: len({j + x for j in range(len(t) - 12) if first[tuple(t[j:j + 13])] < i for x in range(13)}) for i, t in enumerate(texts)}
    assert {x["doc_id"]: x["n_removed"] for x in remove_repeats(df).collect()} == want
    assert sum(n > 0 for n in want.values()) > 50
