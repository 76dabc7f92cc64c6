import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from laneguard.llm import blocks
from laneguard.llm.merkle import manifest
from laneguard.llm.phrases import collocations
from laneguard.llm.queries import BLOCKED_WORDS, QUERIES, RULES
from laneguard.llm.url_filter import Cascade, Level, hosts_with_words, judge_urls
from tests.llm.rows import hard_docs, no_docs


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def brute_manifest(rows, fanout):
    """``rows``: (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def up(nodes):
        return [sha(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append(up(out[-1]))
        return out

    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by_lang[lang]])
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for g, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                changed = (*row[:4], ascii_lower(row[4]))
            node, sibs = leaf(changed), []
            for levels, at in ((trees[lang], i), (top, g)):
                for nodes in levels[:-1]:
                    a = at - at % fanout
                    sibs += nodes[a:at] + nodes[at + 1:a + fanout]
                    node, at = sha(*nodes[a:at], node, *nodes[at + 1:a + fanout]), at // fanout
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[lang][-1][0], root, sha(*sibs), node, node == root))
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("fanout", "block_levels", "n"), [(8, 4, 60), (2, 1, 45), (3, 1, 100), (2, 2, 1)])
def test_manifest_equals_brute_force(spark, fanout, block_levels, n):
    r = random.Random(n)
    rows = [(r.choice([None, *range(40)]) if i % 9 == 0 else i, None if i % 5 == 0 else f"s{i % 3}", r.choice([None, "de", "en", "en", "en", "ü", ""]), r.choice([None, i]),
             r.choice([None, "", "Ünd A text", "lower only", "X" * 3000])) for i in range(n)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS grp", "2 AS idx", "'x' AS leaf", "'y' AS part")
    got = [tuple(x) for x in manifest(docs.repartition(3), fanout=fanout, block_levels=block_levels).collect()]
    assert order(got) == order(brute_manifest(rows, fanout))


def test_manifest_of_hard_rows_and_of_none(spark):
    docs = hard_docs(spark)
    rows = [tuple(x) for x in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    for levels in (1, 4):
        got = [tuple(x) for x in manifest(docs, block_levels=levels).collect()]
        assert order(got) == order(brute_manifest(rows, 8))
    assert {x[-1] for x in got} == {True, False}
    assert manifest(no_docs(spark)).collect() == []


def brute_urls(rows, rules, listed):
    out = []
    for page_id, url in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (ascii_lower(m[1]), m[2]) if m else ("", "")
        above = {host[i:] for i in range(len(host)) if i == 0 or host[i - 1] == "."}
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and h in above and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page_id, host, path, best and best[3], best[4] if best else "block" if above & listed else "allow"))
    return out


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/", "x://Example.org/ES/", "https://example.org/en/1", "https://a.example.org/en/12?q=/es/", "https://example.org", "https://example.org?x", "https://example.org#/",
        "http://org/", "http://borg/x", "http://a.b.com/fr/1://x.org/", "http://com/de/", "http://b.com/de", "http://spam.example.com/x", "http://www.spam-farm.com/y", "http://sub.www.spam-farm.com/", "http://spam.org/z",
        "http://..com/fr/", "a://b://c/d", "http://ex\nample.com/de/x", "http://пример.com/fr/ü", "http://" + "a." * 60 + "com/de/" + "p" * 5000]


@pytest.mark.parametrize("part_bytes", [1 << 20, 2])
def test_url_verdicts_equal_brute_force(spark, part_bytes):
    r = random.Random(3)
    rows = [(i % 50 or None, u) for i, u in enumerate(URLS * 2)] + [(1000 + i, f"http://{r.choice('abc')}.h{i % 90}.net/{'xyz'[i % 3]}{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'q' AS host", "1 AS path", "2 AS hits", "3 AS key").repartition(4)
    rules = [*RULES, ("com", "/fr/", "block"), ("", "/", "block"), (None, "/", "block"), ("b.com", "/fr/1", "allow"), ("h5.net", "", "block"), ("a.h5.net", "/x", "allow"), ("net", "/x1", "block")]
    hosts = {f"h{i}.net" for i in range(0, 90, 4)} | {"www.spam-farm.com", "unseen.net"}
    listed = spark.createDataFrame([(h,) for h in [*hosts, None, "", "h4.net"]], "host string")
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), listed, part_bytes=part_bytes)
    want = brute_urls(rows, [x for x in rules if x[0]], hosts)
    assert order(map(tuple, got.collect())) == order(want)
    assert {x[-1] for x in want} == {"allow", "block"}


def test_urls_of_no_rows_no_rules_and_text_ids(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    none = spark.createDataFrame([], "host string")
    pages = spark.createDataFrame([("p", "http://a.com/x"), (None, None)], "page_id string, url string")
    assert order(map(tuple, judge_urls(pages, rules, none).collect())) == order([("p", "a.com", "/x", None, "allow"), (None, "", "", None, "allow")])
    assert judge_urls(pages.limit(0), rules, none).collect() == []
    assert [r["host"] for r in hosts_with_words(spark.createDataFrame([("http://A-Spam.de/",), (None,), ("http://spammer.de",)], "url string"), BLOCKED_WORDS).collect()] == ["a-spam.de"]


def test_cascade_levels_decide_by_parity():
    class Fixed(Level):
        def __init__(self, known):
            self.known = known

        def has(self, h1, h2):
            return np.isin(h1, self.known)

    keys = np.arange(6)
    cascade = Cascade([Fixed([1, 2, 3, 4]), Fixed([2, 3, 4]), Fixed([3, 4]), Fixed([4])])
    assert cascade.listed(keys, keys).tolist() == [False, True, False, True, False, False]
    assert not Cascade([]).listed(keys, keys).any()


def brute_phrases(rows, max_words=3, min_count=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", ascii_lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        longer = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        best = []
        for p, a in cand.items():
            if 100 * longer[p] < 50 * a:
                score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return out


@pytest.mark.parametrize("period", [1, 2, 32, 1 << 40])
def test_phrases_equal_brute_force(spark, period):
    r = random.Random(period)
    vocabulary = ["New", "york", "é", "the", "a", "x1", "日本", "of"]
    texts = [" ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", ". ", "\t", "!?", "\n"]) for _ in range(r.randint(0, 80))) for _ in range(60)]
    texts += ["spam " * 3000, "same words here again and again. " * 40, texts[0], texts[0], None, "", " \n.,", "a", "New york"]
    rows = [(r.choice(["en", "de", None, "und"]), t) for t in texts]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS slice", "'q' AS chunk", "2 AS n", "3 AS a").repartition(4)
    assert order(map(tuple, collocations(docs, period=period).collect())) == order(brute_phrases(rows))
    if period == 2:
        assert order(map(tuple, collocations(docs, max_words=4, min_count=3, top=7, period=period).collect())) == order(brute_phrases(rows, 4, 3, 7))
        assert order(map(tuple, collocations(docs, max_words=2, period=period).collect())) == order(brute_phrases(rows, 2))


def test_phrases_of_hard_rows_and_of_none(spark):
    docs = hard_docs(spark)
    rows = [(x["lang"], x["text"]) for x in docs.collect()]
    assert order(map(tuple, collocations(docs).collect())) == order(brute_phrases(rows))
    assert collocations(no_docs(spark)).collect() == []


def test_score_products_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a = 3_000_000_000
    row = spark.range(1).select(*[F.lit(a).cast("decimal(19,0)").alias(c) for c in "al"])
    assert row.select((F.lit(1000000).cast("decimal(7,0)") * (F.col("a") * F.col("a"))).alias("p"), (F.col("l") * F.col("l")).alias("q")).selectExpr("p div q AS s").first()["s"] == 1000000


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        values = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
        assert np.array_equal(blocks.unpack(blocks.pack(values)), values)
        counts = rng.integers(1, 1 << 40, n)
        assert np.array_equal(blocks.unpack_counts(blocks.pack_counts(counts)), counts)
    assert blocks.spans(np.array([2, 2, 5])) == [(2, 0, 2), (5, 2, 3)]


def test_new_queries_read_whole_tables(spark, sf_dir):
    counts = {name: QUERIES[name](spark, sf_dir).count() for name in ("op11_merkle_manifest", "op12_url_filter", "op13_phrases")}
    assert counts["op11_merkle_manifest"] == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert counts["op12_url_filter"] == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert counts["op13_phrases"] > 0
