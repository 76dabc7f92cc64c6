"""Sharding, packing and mixing against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from laneguard.llm.mixing import mix_sources
from laneguard.llm.packing import _encoder, _knapsack, _plan, pack_documents, pack_histogram
from laneguard.llm.queries import QUERIES, domain_of, weights_table
from laneguard.llm.registry import CHECKS
from laneguard.llm.sharding import minimax_cuts, shard_by_bytes

from .rows import hard_docs, no_docs


def smallest_capacity(sizes, k):
    def feasible(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= k
    c = max(max(sizes), -(-sum(sizes) // k))
    while not feasible(c):
        c += 1
    return c


@pytest.mark.parametrize("local", [50_000, 40])
def test_cuts_are_minimax(spark, monkeypatch, local):
    monkeypatch.setattr("laneguard.llm.sharding.LOCAL_SUMS", local)
    r = random.Random(3)
    sizes = [r.choice([1, 2, 5, 40, 300]) for _ in range(400)]
    sums, s = [], 0
    for x in sizes:
        s += x
        sums.append((s,))
    ends = minimax_cuts(spark.createDataFrame(sums, "s long"), s, max(sizes), 8)
    assert ends[-1] == s and max(b - a for a, b in zip([0, *ends], ends)) == smallest_capacity(sizes, 8)


def test_shards_keep_groups_and_balance(spark):
    docs = hard_docs(spark)
    want = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = shard_by_bytes(docs).collect()
    text_of = defaultdict(list)
    for i, t in want:
        text_of[i].append(t)
    assert len(got) == len(want)
    shards = defaultdict(set)
    slots = defaultdict(list)
    sizes = Counter()
    for r in got:
        t = text_of[r["doc_id"]][0]
        raw = (t or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        shards[t].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for i, t in want:
        n, first = groups.get(t, (0, (1, 0)))
        groups[t] = (n + 1, min(first, (0 if i is None else 1, i or 0)) if n else (0 if i is None else 1, i or 0))
    ordered = [(len((t or "").encode()) + 1) * n for t, (n, first) in sorted(groups.items(), key=lambda g: g[1][1])]
    assert max(sizes.values()) == smallest_capacity(ordered, 8)
    assert shard_by_bytes(no_docs(spark)).count() == 0


def test_histogram_packing_is_complete_and_tight():
    r = random.Random(1)
    for _ in range(3):
        counts = Counter(r.choice([r.randint(1, 1024), r.randint(200, 400)]) for _ in range(4000))
        plan = pack_histogram(dict(counts), 1024)
        placed = Counter()
        for config, times in plan:
            assert sum(config) <= 1024 and times > 0
            for length in config:
                placed[length] += times
        assert placed == counts
        assert sum(t for _, t in plan) <= 1.02 * sum(k * v for k, v in counts.items()) / 1024 + 2
    assert pack_histogram({}, 1024) == []


def test_the_program_places_most_pieces_at_any_scale():
    r = random.Random(6)
    counts = Counter(min(1024, int(r.lognormvariate(5.6, 0.9)) + 1) for _ in range(6000))
    for scale in (1, 10**9):
        plan = _plan({k: n * scale for k, n in counts.items()}, 1024)
        placed, by = Counter(), Counter()
        for config, times, origin in plan:
            assert sum(config) <= 1024 and times > 0
            by[origin] += len(config) * times
            for length in config:
                placed[length] += times
        assert placed == {k: n * scale for k, n in counts.items()}
        assert by["program"] >= 0.9 * (by["program"] + by["rest"])
        assert sum(t for _, t, _ in plan) <= 1.01 * scale * sum(k * n for k, n in counts.items()) / 1024 + 2
        assert len(plan) < 8000


def test_knapsack_equals_enumeration():
    r = random.Random(7)
    for _ in range(30):
        lengths = np.array(sorted(r.sample(range(1, 30), 5)))
        price = np.array([r.random() for _ in lengths])
        best = [0.0] * 41
        for w in range(1, 41):
            best[w] = max([best[w - 1]] + [best[w - n] + p for n, p in zip(lengths, price) if n <= w])
        config = _knapsack(lengths, price, 40)
        assert config @ lengths <= 40 and abs(config @ price - best[40]) < 1e-9


def test_encoder_equals_the_library_on_random_texts():
    from tokenizers import Tokenizer
    import public_tokenizers
    exact, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), _encoder("byte_bpe_50k.json")
    r = random.Random(12)
    alphabet = "etaoin shrdlu  \n\tETAOIN0123456789.,'-<|>_éß日本🙂\u0301\u00a0\u200b"
    for _ in range(1500):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(1, 80)))
        assert fast(t) == exact.encode(t, add_special_tokens=False).ids


def test_pieces_round_trip(spark):
    docs = hard_docs(spark)
    got = pack_documents(docs).collect()
    from tokenizers import Tokenizer
    import public_tokenizers
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for row in docs.collect():
        ids = exact.encode(row["text"] or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        at = 0
        for k, end in enumerate(range(first, len(ids) + 1, 1024)):
            want[(row["doc_id"], k, at, end - at, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at:end])))] += 1
            at = end
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack_documents(no_docs(spark)).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer
    import public_tokenizers
    exact, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), _encoder("byte_bpe_50k.json")
    for t in ["", " ", "a  b\n\n c \t", "don't I'll 12 345", "<|endoftext|> x<|endoftext|>", "日本語 テスト é̀   x", "\x00\x1f", "🙂🙂 a", "x" * 3000]:
        assert fast(t) == exact.encode(t, add_special_tokens=False).ids


def test_mix_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.execute(CHECKS["op9_mix_sources"])
    cols = [c[0] for c in rel.description]
    want = sorted(rel.fetchall())
    got = QUERIES["op9_mix_sources"](spark, sf_dir)
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == want and want


def test_mix_moves_shortages_to_siblings_first(spark):
    rows = [(i, "w " * 10, lang, src) for i, (lang, src) in enumerate([("a", "s1")] * 2 + [("a", "s3")] * 40 + [("b", "s5")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix_sources(docs, weights_table(spark), domain_of(), (1, 2), 1).collect()
    used = Counter()
    for r in got:
        used[(r["lang"], r["source"])] += r["epochs"] * r["tokens"]
    assert used[("a", "s1")] == 20
    # all three sources lie in two domains: s1 and s5 in domain1, s3 in domain3
    assert sum(used.values()) <= 410 and used[("b", "s5")] > used[("a", "s1")]
    hard = mix_sources(hard_docs(spark), weights_table(spark), domain_of())
    assert hard.count() == hard_docs(spark).count()
    assert mix_sources(no_docs(spark), weights_table(spark), domain_of()).count() == 0
