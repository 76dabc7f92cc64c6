"""Vector dedup, vector search and the n-gram join against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest

from laneguard.llm.ann import nearest_neighbours
from laneguard.llm.linkage import connected_components
from laneguard.llm.near_vectors import near_vectors
from laneguard.llm.ngram_join import BOUNDS, bucket_keys, largest_difference, ngram_components
from laneguard.llm.queries import QUERIES
from laneguard.llm.registry import CHECKS

from .rows import hard_docs, no_docs

VECTORS = "vec_id long, embedding array<float>, label int, h string, item long, w long, g string"


def groups(n, links):
    root = list(range(n))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def hard_vectors(spark, n=600, dim=12, seed=4):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    for i in range(n // 2, n):
        x[i] = x[r.integers(0, n // 2)] * r.choice([1, 3]) + r.choice([0, 0.05, 0.1]) * r.standard_normal(dim)
    rows = [(i, [float(v) for v in x[i]], int(i % 3) if i % 17 else None) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [nan] + [1.0] * (dim - 1), 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, [inf] * dim, 1), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1)]
    rows += [(n + 10 + i, rows[7][1], rows[7][2]) for i in range(40)]
    return rows, spark.createDataFrame([(*x, "h", 1, 2, "g") for x in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("cell_rows", [1000, 20])
def test_near_vectors(spark, monkeypatch, cell_rows):
    monkeypatch.setattr("laneguard.llm.near_vectors.CELL_ROWS", cell_rows)
    monkeypatch.setattr("laneguard.llm.near_vectors.BLOCK", 64)
    rows, df = hard_vectors(spark)
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, n_links = [], [0] * len(rows)
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    links.append((i, j))
                    n_links[i] += 1
                    n_links[j] += 1
    root = groups(len(rows), links)
    want = sorted((rows[i][0], n_links[i], rows[root[i]][0], root[i] == i) for i in range(len(rows)))
    assert sorted(tuple(r) for r in near_vectors(df).collect()) == want
    assert near_vectors(df.limit(0)).count() == 0


def test_search_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr("laneguard.llm.ann.PART_ROWS", 150)
    monkeypatch.setattr("laneguard.llm.ann.QUERY_ROWS", 10)
    rows, df = hard_vectors(spark)
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    got = {}
    for r in nearest_neighbours(df, every=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    queries = [(i, v) for i, v in ok if i % 7 == 0 and len(v) == 12]
    for q, v in queries:
        want = sorted((np.sqrt(((v - x) ** 2).sum()), i) for i, x in ok if i != q and len(x) == 12)[:10]
        have = sorted(got[q])
        assert [r for r, _, _ in have] == list(range(1, 11))
        assert [(s, i) for _, i, s in have] == sorted((s, i) for _, i, s in have)
        exact = dict(ok)
        assert all(abs(s - np.linalg.norm(exact[i] - v)) < 1e-9 for _, i, s in have)
        hits += len({i for _, i in want} & {i for _, i, _ in have})
        total += 10
    assert hits / total >= 0.95
    assert nearest_neighbours(df.limit(0)).count() == 0
    few = nearest_neighbours(df.filter("vec_id < 4"), every=2).collect()
    assert len(few) == 6


@pytest.mark.parametrize("name", ["op2_near_vectors", "op5_ngram_join"])
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(CHECKS[name])
    cols = [c[0] for c in rel.description]
    want = sorted(rel.fetchall())
    assert sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).select(*cols).collect()) == want and want


def test_search_recall_on_tables(spark, sf_dir):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op4_nearest_neighbours"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len({i for _, i in sorted((np.linalg.norm(v - x), i) for i, x in rows if i != q)[:10]} & got[q]) for q, v in rows if q % 100 == 0]
    assert sum(hits) >= 0.9 * 10 * len(hits) and hits


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} - {()} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near_texts(n=420, seed=9):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out).split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w += r.choices(vocabulary, k=r.randint(1, 9))
        else:
            w = r.choices(vocabulary, k=r.choice([3, 8, 12, 20, 40, 90, 300]))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,num,sent,shingles_a_slice", [(4, 85, 1 << 20, 1 << 18), (5, 80, 0, 50)])
def test_ngram_join(spark, monkeypatch, k, num, sent, shingles_a_slice):
    monkeypatch.setattr("laneguard.llm.ngram_join.MAX_SENT_IDS", sent)
    monkeypatch.setattr("laneguard.llm.ngram_join.SLICE", shingles_a_slice)
    df = hard_docs(spark, near_texts())
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None
             and len(sets[i] & sets[j]) and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    assert len(links) > 60
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    place = {i: p for p, i in enumerate(order)}
    root = groups(len(rows), [(place[a], place[b]) for a, b in links])
    want = []
    for i, (doc, _) in enumerate(rows):
        c = rows[order[root[place[i]]]][0]
        if doc is None:
            c = next((rows[order[root[place[j]]]][0] for j in range(len(rows)) if rows[j][0] is not None and sets[j] == sets[i]), None)
        want.append((doc, len(sets[i]), c))
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(r) for r in ngram_components(df, k, num).collect()), key=key) == sorted(want, key=key)
    assert ngram_components(no_docs(spark)).count() == 0


def test_linked_sets_share_a_key():
    r = np.random.default_rng(1)
    for num in (85, 80):
        for _ in range(1500):
            n = int(r.choice([3, 7, 9, 13, 20, 35, 60, 200, 900]))
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            b = a.copy()
            change = int(r.integers(0, max(2, n // 5)))
            b = np.concatenate([b[int(r.integers(0, change + 1)):], r.integers(0, 1 << 63, int(r.integers(0, change + 1)), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if set(a) != set(b) and 100 * both >= num * len(np.union1d(a, b)):
                assert len(np.setxor1d(a, b)) <= largest_difference(len(a) + len(b), num, 100)
                assert len(np.intersect1d(bucket_keys(np.unique(a), num, 100), bucket_keys(np.unique(b), num, 100)))
    assert BOUNDS[0] == 1 and (np.diff(BOUNDS) > 0).all()


def test_sets_that_share_nothing_meet_in_no_bucket():
    r = np.random.default_rng(2)
    for num in (85, 80):
        keys = np.concatenate([bucket_keys(np.unique(r.integers(0, 1 << 63, 100, dtype=np.uint64)), num, 100) for _ in range(300)])
        assert len(keys) > 300 and len(np.unique(keys)) == len(keys)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}}


def test_packed_blocks_chain_every_item_of_a_key_once(spark, monkeypatch):
    from collections import defaultdict

    import numpy as np

    from laneguard.llm import linkage

    rng = np.random.default_rng(7)
    parts = []
    for _ in range(6):
        key = rng.integers(0, 40, 300).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)
        key[:60] = key[0]  # a hot key
        parts.append((key, rng.integers(-50, 50, 300)))
    monkeypatch.setattr(linkage, "TASK_KEYS", 500)
    frames = [f for part in range(0, 6, 3) for f in linkage.key_blocks(iter(parts[part:part + 3]), 7)]
    rows = [tuple(r) for f in frames for r in f.itertuples(index=False)]
    chain = linkage.chain_blocks(spark.createDataFrame(rows, linkage.KEY_BLOCKS)).collect()
    items, pairs = defaultdict(set), defaultdict(list)
    for key, sid in parts:
        for k, x in zip(key.view(np.int64).tolist(), sid.tolist()):
            items[k].add(x)
    for r in chain:
        assert r.a < r.b
        pairs[r.key].append((r.a, r.b))
    assert any(len(x) > 20 for x in items.values())
    for k, members in items.items():
        assert sorted(b for _, b in pairs[k]) == sorted(members - {min(members)})
        assert {a for a, _ in pairs[k]} <= members
    assert list(linkage.key_blocks(iter([]), 7)) == []


def test_a_group_of_near_copies_lists_no_pairs(spark, monkeypatch):
    """Near copies that the chain leaves in several components: the comparison gives fewer pairs than it gets members, also
    where the screen lets pairs through that are no links."""
    from laneguard.llm import linkage

    r = random.Random(4)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for i in range(90):
        w = list(base)
        for p in r.sample(range(160), r.choice([1, 2, 3, 4])):
            w[p] = f"x{i}_{p}"
        texts.append(" ".join(w))
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i in range(90) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert 0 < len(links) < 90 * 89 // 2
    root = groups(90, links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, forest = [], linkage._cross_forest
    monkeypatch.setattr(linkage, "BLOCK", 32)
    monkeypatch.setattr(linkage, "EXACT_BLOCK", 16)

    def counted(members, info, *rest):
        out = forest(members, info, *rest)
        made.append((members.count(), out.count(), "items" in info.columns))
        return out
    monkeypatch.setattr(linkage, "_cross_forest", counted)
    monkeypatch.setattr("laneguard.llm.ngram_join.FINE", 1)  # a blunt screen: many of its pairs are no links
    got = {row["doc_id"]: row["component_id"] for row in ngram_components(docs).collect()}
    assert got == {i: root[i] for i in range(90)}
    assert made and all(pairs < members for members, pairs, _ in made) and any(whole for _, _, whole in made)
