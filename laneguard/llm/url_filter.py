"""URL filter with a Bloom filter cascade over all keys of the corpus.

Every url stands for a few keys: each rule-length start of its path behind its host and behind each parent domain, and
those hosts alone. Level 1 of the cascade encodes the listed keys, level 2 those other keys of the corpus that level 1
lets through, level 3 the listed keys that level 2 lets through, and so on until nothing is left over. Since the
levels are built from the complete key universe, looking a key up is exact, and urls are judged in one map without a
join: each task needs the cascade only.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneguard.llm.words import mix
from laneguard.session import materialize

PART_BYTES = 64 << 20
"""Bytes of one broadcast cascade. Listed keys that need more are dealt to several cascades, and urls pass one after the other."""
MAX_LEVELS = 64
BLOCK, ALLOW, HOST = "b", "a", "h"
"""First letter of a key: blocking rule, allowing rule, listed host."""


def host_of(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end, as it is."""
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _keys(lengths: list[int]) -> Column:
    """All keys of a row with ``host`` and ``path``: longer ones first, blocking before allowing rules, then hosts."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = F.when(F.col("host") != "", suffixes).otherwise(F.array().cast("array<string>"))
    starts = F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    rules = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(starts, lambda p: p.isNotNull()), lambda p: F.concat(s, p))))
    longest = F.array_sort(rules, lambda x, y: F.when(F.char_length(x) != F.char_length(y), F.char_length(y) - F.char_length(x)).otherwise(F.instr(y, "/") - F.instr(x, "/")))
    both = F.flatten(F.transform(longest, lambda k: F.array(F.concat(F.lit(BLOCK), k), F.concat(F.lit(ALLOW), k))))
    return F.concat(both, F.transform(suffixes, lambda s: F.concat(F.lit(HOST), s)))


def _hashes(key) -> list[Column]:
    """Two independent 64-bit hashes of a key."""
    return [F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)]


class Level:
    """One Bloom filter: ``words`` of 64 bits and the number of probes."""

    def __init__(self, number: int, n: int, rate: float):
        self.number, self.probes = number, max(1, round(-math.log2(rate)))
        self.bits = max(64, -(-math.ceil(n * -math.log2(rate) / math.log(2)) // 64) * 64)
        self.words = np.zeros(self.bits // 64, np.uint64)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        """The bit that each probe of each key reads, told apart by level."""
        a, b = mix(h1.view(np.uint64), self.number), mix(h2.view(np.uint64), self.number) | np.uint64(1)
        for i in range(self.probes):
            yield (a + np.uint64(i) * b) % np.uint64(self.bits)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in self.places(h1, h2):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def fill(self, keys: DataFrame) -> Level:
        """Encodes ``keys(h1, h2)``: tasks set bits, words are combined by OR."""

        def bits(batches):
            for batch in batches:
                at = np.unique(np.concatenate(list(self.places(batch["h1"].to_numpy(), batch["h2"].to_numpy()))))
                word = (at >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                values = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
                yield pd.DataFrame({"word": word[first], "bits": values.view(np.int64)})

        for row in keys.mapInPandas(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
            self.words[row["word"]] = np.uint64(row["bits"] & 0xFFFFFFFFFFFFFFFF)
        return self


class Cascade:
    """Levels in order; a key of the universe is listed if the first level that lacks it has an even number."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def size(self) -> int:
        return sum(level.words.nbytes for level in self.levels)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for i, level in enumerate(self.levels):
            passed = level.has(h1[open_], h2[open_])
            out[open_[~passed]] = i % 2 == 1
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """Rows of ``keys(key, h1, h2)`` that a level has."""
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches):
        for batch in batches:
            yield batch[sent.value.has(batch["h1"].to_numpy(), batch["h2"].to_numpy())]

    return keys.mapInPandas(keep, "key string, h1 long, h2 long")


def build_cascade(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> Cascade:
    """Cascade of ``listed(key, h1, h2)`` (distinct) over ``universe(key, h1, h2)`` (may repeat); the counts only set sizes.

    What level 1 lets through is made distinct and compared with the list by the keys themselves, so the universe is
    never shuffled as a whole.
    """
    if not n_listed:
        return Cascade([])
    rate = min(0.5, max(1e-6, math.sqrt(0.5) * n_listed / max(1, n_universe)))
    levels = [Level(1, n_listed, rate).fill(listed)]
    inside, outside = listed, materialize(_passing(universe, levels[0]).distinct().join(listed.select("key"), "key", "left_anti"), "url-others")
    while True:
        turn = outside if len(levels) % 2 else inside
        n = turn.count()
        if not n:
            return Cascade(levels)
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("a listed and another key have equal hashes")
        levels.append(Level(len(levels) + 1, n, 0.5).fill(turn))
        if len(levels) % 2:
            outside = materialize(_passing(outside, levels[-1]), "url-others")
        else:
            inside = materialize(_passing(inside, levels[-1]), "url-listed")


def judge_urls(pages: DataFrame, rules: DataFrame, listed_hosts: DataFrame, part_bytes: int = PART_BYTES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    ``rules(host, path, verdict)`` fit their host and its subdomains where the path starts with theirs. The longest
    rule (of equally long ones that with the longer host; of equal ones the blocking one) gives the verdict. Without a
    rule, a url is blocked if its host or a parent domain is in ``listed_hosts(host)``, else allowed. Null urls and
    urls without ``://`` have an empty host and path, fit nothing and are allowed. Repeated rows and null ids stay; an
    empty table gives no rows; rules or hosts that are null or empty list nothing. Other columns are not read. The
    driver holds the lengths of rule paths (few) and one cascade of ``part_bytes`` at most at a time.
    """
    spark = pages.sparkSession
    own = rules.filter("host != '' and path is not null and verdict in ('allow', 'block')")
    own = own.select(F.concat(F.when(F.col("verdict") == "block", F.lit(BLOCK)).otherwise(F.lit(ALLOW)), "host", "path").alias("key"), F.char_length("path").alias("n"))
    lengths = sorted(r["n"] for r in own.select("n").distinct().collect())
    listed = own.select("key").unionAll(listed_hosts.filter("host != ''").select(F.concat(F.lit(HOST), "host").alias("key"))).distinct()
    listed = materialize(listed.select("key", *[h.alias(n) for n, h in zip(("h1", "h2"), _hashes("key"))]), "url-list")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    universe = rows.select(F.explode(_keys(lengths)).alias("key"))
    universe = universe.select("key", *[h.alias(n) for n, h in zip(("h1", "h2"), _hashes("key"))])
    n_listed, n_universe = listed.count(), universe.agg(F.approx_count_distinct("key")).first()[0]
    parts = max(1, math.ceil(n_listed * (3 + math.log2(1 + n_universe / max(1, n_listed))) * 2 / 8 / part_bytes))
    rows = rows.withColumn("hits", F.array().cast("array<int>"))
    for part in range(parts):
        mine = (lambda df: df.filter(F.pmod("h1", F.lit(parts)) == part)) if parts > 1 else (lambda df: df)  # noqa: B023
        sent = spark.sparkContext.broadcast(build_cascade(mine(listed), mine(universe), -(-n_listed // parts), -(-n_universe // parts)))
        hashes = F.transform(_keys(lengths), lambda k: _hashes(k)[0]), F.transform(_keys(lengths), lambda k: _hashes(k)[1])

        def look_up(batches, sent=sent, part=part):
            for batch in batches:
                sizes = batch["h1"].map(len).to_numpy()
                h1, h2 = (np.concatenate([np.zeros(0, np.int64), *batch[c]]).astype(np.int64) for c in ("h1", "h2"))
                ours = np.ones(len(h1), bool) if parts == 1 else h1 % parts == part
                found = np.flatnonzero(ours)[sent.value.listed(h1[ours], h2[ours])]
                begin = np.cumsum(sizes) - sizes
                row = np.searchsorted(begin + sizes, found, "right")
                new = np.split((found - begin[row]).astype(np.int32), np.searchsorted(row, np.arange(1, len(batch))))
                hits = [np.concatenate([h, n]).astype(np.int32) for h, n in zip(batch["hits"], new)]
                yield batch[[*carried]].assign(hits=hits)

        carried = ("page_id", "host", "path")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*carried).schema) + ", hits array<int>"
        rows = rows.select("*", hashes[0].alias("h1"), hashes[1].alias("h2")).mapInPandas(look_up, schema)
        rows = materialize(rows, "url-hits") if parts > 1 else rows
    first = F.array_min("hits")
    key = F.when(first.isNotNull(), F.get(_keys(lengths), first))
    kind = F.substring(key, 1, 1)
    out = rows.select("page_id", "host", "path", key.alias("key"), kind.alias("kind"))
    rule = F.when(F.col("kind") != HOST, F.expr("substring(key, 2)"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.when(F.col("kind").isin(BLOCK, HOST), "block").otherwise("allow").alias("verdict"))


def hosts_with_words(pages: DataFrame, words: list[str], url_col: str = "url") -> DataFrame:
    """Distinct hosts of the table with a label part (between dots and hyphens) that is one of ``words``: ``host``."""
    host = pages.select(host_of(url_col).alias("host")).distinct()
    return host.filter(F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in words])))
