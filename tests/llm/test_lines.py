"""Line dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from laneguard.llm.line_dedup import Lines, _plain_distance, dedup_lines, segment_keys, within_edits

from .rows import hard_docs, no_docs


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=14), st.text("abé", max_size=14)), min_size=1, max_size=20), st.integers(1, 3))
def test_banded_distance(pairs, edits):
    got = within_edits([a for a, _ in pairs], [b for _, b in pairs], edits)
    assert got.tolist() == [_plain_distance(a, b) <= edits for a, b in pairs]


def edited(r, line, n):
    for _ in range(n):
        i = r.randrange(len(line))
        line = r.choice([line[:i] + line[i + 1:], line[:i] + r.choice("abxy é") + line[i:], line[:i] + r.choice("abxy") + line[i + 1:]])
    return line


def test_linked_lines_share_a_key():
    r = random.Random(6)
    for edits in (1, 2, 3):
        for _ in range(400):
            a = "".join(r.choice("abcdefgh ") for _ in range(r.randint(24, 60)))
            b = edited(r, a, r.randint(1, edits))
            if min(len(a), len(b)) >= 24 and "\n" not in b:
                lines = Lines([a, b])
                keys, owner = segment_keys(lines, np.arange(2), edits, 24)
                assert set(keys[owner == 0]) & set(keys[owner == 1])


def near_lines(seed=3):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefghij klmno") for _ in range(r.choice([10, 24, 26, 40, 90]))) for _ in range(30)]
    out = []
    for _ in range(60):
        lines = []
        for _ in range(r.randint(1, 6)):
            line = r.choice(base)
            lines.append(line if r.random() < 0.3 else edited(r, line, r.choice([1, 1, 2, 3, 5])))
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("block", [256, 8])
def test_dedup_lines(spark, monkeypatch, block):
    monkeypatch.setattr("laneguard.llm.linkage.BLOCK", block)
    df = hard_docs(spark, near_lines())
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    first = {}
    for doc, t in rows:
        for i, line in enumerate((t or "").split("\n") if doc is not None and t is not None else []):
            if line.strip():
                first[line] = min(first.get(line, (doc, i)), (doc, i))
    names = sorted(first, key=first.get)
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for j, b in enumerate(names):
        for a in names[:j]:
            if min(len(a), len(b)) >= 24 and abs(len(a) - len(b)) <= 2 and _plain_distance(a, b) <= 2:
                x, y = sorted((find(a), find(b)), key=first.get)
                root[y] = x
    want = Counter()
    removed = 0
    for doc, t in rows:
        if t is None:
            want[(doc, None, 0, 0)] += 1
            continue
        lines = t.split("\n")
        keep = [x for i, x in enumerate(lines) if doc is None or not x.strip() or first[find(x)] == (doc, i)]
        want[(doc, "\n".join(keep), len(lines), len(lines) - len(keep))] += 1
        removed += len(lines) - len(keep)
    got = dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == want
    assert removed > 80
    assert dedup_lines(no_docs(spark)).count() == 0


def test_a_common_line_sends_each_key_once(spark, monkeypatch):
    from laneguard.llm import line_dedup

    sent, link = [], line_dedup.link_buckets

    def counted(keys, *rest):
        sent.append((keys.count(), keys.distinct().count()))
        return link(keys, *rest)
    monkeypatch.setattr(line_dedup, "link_buckets", counted)
    monkeypatch.setattr("laneguard.llm.words.CHUNK_BYTES", 100)
    docs = [(i, f"a line that every text of this table holds\nown line of text number {i} and no other") for i in range(40)]
    assert dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).agg({"n_removed": "sum"}).first()[0] >= 39
    assert sent and sent[0][0] == sent[0][1]


def test_keys_with_the_same_lines_are_labelled_once(spark, monkeypatch):
    """Near copies share many keys: what is joined with their components grows with the lines, not with lines times keys."""
    from laneguard.llm import linkage

    given_rows, label = [], linkage._labelled

    def counted(pairs, components):
        if "key" in pairs.columns:
            given_rows.append(pairs.count())
        return label(pairs, components)
    monkeypatch.setattr(linkage, "_labelled", counted)
    lines = [f"the same long beginning of all lines, the same middle of all lines, an end {i:02d}" for i in range(60)]
    got = dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4))
    assert got.agg({"n_removed": "sum"}).first()[0] == 59
    assert given_rows and max(given_rows) < 3 * len(lines)


def test_lines_of_other_characters_are_not_compared(monkeypatch):
    from laneguard.llm import line_dedup

    compared, banded = [], line_dedup._banded
    monkeypatch.setattr(line_dedup, "_banded", lambda left, right, edits: compared.append(len(left)) or banded(left, right, edits))
    r = random.Random(2)
    lines = ["".join(r.choice("abcdefgh ijkl") for _ in range(40)) for _ in range(30)]
    pairs = [(x, y) for x in lines for y in lines if x != y] + [(x, edited(r, x, 2)) for x in lines]
    assert within_edits(*(list(side) for side in zip(*pairs)), 2).tolist() == [_plain_distance(x, y) <= 2 for x, y in pairs]
    assert sum(compared) < len(pairs) / 2
