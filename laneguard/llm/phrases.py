"""Phrase collocations by prefix-free parsing.

Texts are cut into overlapping chunks wherever the hash of a window of words is a multiple of ``PERIOD``: a chunk ends
with such a window and the next begins with it. Equal passages give equal chunks wherever they stand, so copies are
parsed once: a dictionary keeps each distinct chunk with its frequency. Phrases are counted inside distinct chunks, each
weighted by its chunk's frequency; one that begins in the overlap belongs to the following chunk only. Whether a chunk
is followed by another can be told from its last window, so that no chunk is the start of a different one.

Counts of all phrases travel as packed blocks of 64-bit hashes. The frequent ones are sent back to one slice of the
dictionary each, which knows their words; all arithmetic is on words and exact decimals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneguard.llm import blocks
from laneguard.llm.words import CHUNK_BYTES, PrefixHash, mix
from laneguard.llm.words import chunks as text_chunks
from laneguard.session import materialize

PERIOD = 32
"""Words between cuts, about."""
SLICE_BYTES = 8 << 20
"""Bytes of distinct chunks that a task holds at a time, about."""
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _PIECE_END.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Pieces:
    """Words of some texts (UTF-8 bytes), A-Z lower-cased: their places, hashes, texts and pieces."""

    def __init__(self, raws: list[bytes]):
        self.data = _LOWER[np.frombuffer(b"\n".join(raws), np.uint8)]
        gap = _GAP[self.data]
        turns = np.flatnonzero(np.diff(np.concatenate(([1], gap.view(np.int8), [1]))))
        self.starts, self.ends = turns[0::2], turns[1::2]
        begins = np.cumsum([0, *[len(r) + 1 for r in raws]])
        self.bounds = np.searchsorted(self.starts, begins)
        self.text = np.repeat(np.arange(len(raws)), np.diff(self.bounds))
        self.piece = np.cumsum(_PIECE_END[self.data])[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.hashes = PrefixHash(self.data).of(self.starts, self.ends) if len(self.data) else np.zeros(0, np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, where the array has so many."""
        n = max(0, len(self.hashes) - k + 1)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += mix(self.hashes[j:j + n], j + 1)
        return mix(total, k)

    def triggers(self, window: int, period: int) -> np.ndarray:
        """Words at which a window of one text begins whose hash cuts."""
        at = np.flatnonzero(mix(self.grams(window), 4242) % np.uint64(period) == 0)
        return at[self.text[at] == self.text[at + window - 1]]

    def chunks(self, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, end word) of all chunks in order."""
        cut = self.triggers(window, period)
        inner = cut[cut > self.bounds[self.text[cut]]]  # a window at the start of a text cuts nothing off
        first = np.sort(np.concatenate([inner, self.bounds[:-1][np.diff(self.bounds) > 0]]))
        nxt = np.append(first[1:], len(self.starts))
        last = np.append(self.text[first][1:] != self.text[first][:-1], True)[:len(first)]
        return first, np.where(last, nxt, nxt + window)

    def owned(self, window: int, period: int) -> np.ndarray:
        """Of texts that are chunks: the words that belong to them, not to the overlap with their next chunk."""
        own = np.ones(len(self.starts), bool)
        at, end = self.triggers(window, period), self.bounds[1:][self.text]
        closing = at[(at + window == end[at]) & (at > self.bounds[self.text[at]])]
        for j in range(window):
            own[closing + j] = False
        return own


def _salt(lang: str) -> np.ndarray:
    """One hash of a language's name, which tells its phrases apart from others."""
    raw = np.frombuffer(lang.encode(), np.uint8).astype(np.uint64)
    return mix(np.sum(mix(raw, 9) * np.arange(1, len(raw) + 1, dtype=np.uint64), dtype=np.uint64, keepdims=True), 3)


def _phrases(rows: pd.DataFrame, max_words: int, period: int):
    """Words, their languages' names, and (k, hash, weight, first word) of all phrases of k words that the chunks of
    ``rows(lang, chunk, n)`` own; some ``CHUNK_BYTES`` of chunks at a time. The phrase of no words stands for all of a language's."""
    cut = np.flatnonzero(np.diff(np.cumsum(rows["chunk"].map(len).to_numpy()) // CHUNK_BYTES, prepend=0))
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)]):
        if a == b:
            continue
        part = rows.iloc[a:b]
        words = Pieces(part["chunk"].tolist())
        own = words.owned(max_words - 1, period)
        codes, names = pd.factorize(part["lang"])
        of_word = codes[words.text]
        salt, weight = np.concatenate([_salt(x) for x in names])[of_word], part["n"].to_numpy()[words.text]
        found = []
        for k in range(1, max_words + 1):
            h = words.grams(k)
            at = np.flatnonzero(own[:len(h)])
            at = at[(words.piece[at] == words.piece[at + k - 1]) & (words.text[at] == words.text[at + k - 1])]
            found.append((k, mix(h[at] ^ salt[at], 77), weight[at], at))
        for i, x in enumerate(names):
            mine = np.flatnonzero(own & (of_word == i))
            if len(mine):
                found.append((0, mix(_salt(x), 78), np.array([weight[mine].sum()]), mine[:1]))
        yield words, names[of_word], found


def dictionary(docs: DataFrame, window: int, slices: int, period: int, lang_col: str, text_col: str) -> DataFrame:
    """Distinct chunks ``slice, lang, chunk, n`` with their frequencies, slice by slice."""

    def parse(batches):
        for batch in batches:
            lang = batch["lang"].to_numpy()
            for at, raws in text_chunks(batch["text"].tolist()):
                words = Pieces(raws)
                first, end = words.chunks(window, period)
                raw = words.data.tobytes()
                found = [raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[end - 1].tolist())]
                frame = pd.DataFrame({"lang": lang[at + words.text[first]], "chunk": found})
                yield frame.groupby(["lang", "chunk"], sort=False).size().reset_index(name="n")

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(parse, "lang string, chunk binary, n long")
    found = found.withColumn("slice", F.pmod(F.xxhash64("lang", "chunk"), F.lit(slices)).cast("int")).repartition("slice")
    return found.groupBy("slice", "lang", "chunk").agg(F.sum("n").alias("n")).sortWithinPartitions("slice")


def frequent_phrases(chunks: DataFrame, max_words: int, min_count: int, buckets: int, period: int) -> DataFrame:
    """``lang, phrase, words, f`` of all phrases of up to ``max_words`` words with ``f >= min_count`` and of no words (all of a language's)."""

    def count(batches):
        def packed(part: int, held: list[pd.DataFrame]) -> pd.DataFrame:
            found = [x for _, _, some in _phrases(pd.concat(held), max_words, period) for x in some]
            h, weight = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
            order = np.argsort(h)
            h, first = h[order], np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))
            n, h = np.add.reduceat(weight[order], first), h[first]
            of = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ranges of hashes
            out = [(b, part, blocks.pack(h[i:j]), blocks.pack_counts(n[i:j])) for b, i, j in blocks.spans(of)]
            return pd.DataFrame(out, columns=["bucket", "slice", "hashes", "counts"])

        held, size, at = [], 0, None
        for batch in batches:
            for part, rows in batch.groupby("slice", sort=False):
                if held and (part != at or size >= SLICE_BYTES):
                    yield packed(at, held)
                    held, size = [], 0
                at = part
                held.append(rows)
                size += int(rows["chunk"].map(len).sum())
        if held:
            yield packed(at, held)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        """Frequent hashes of a bucket, each with the first slice that has it."""
        h = [blocks.unpack(x) for x in rows["hashes"]]
        n = np.concatenate([blocks.unpack_counts(x) for x in rows["counts"]])
        part = np.repeat(rows["slice"].to_numpy(), [len(x) for x in h])
        h = np.concatenate(h)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(h) != 0)))
        f = np.add.reduceat(n[order], first)
        ok = f >= min_count
        h, f, part = h[first][ok], f[ok], part[order][first][ok]
        order = np.argsort(part, kind="stable")
        h, f, part = h[order], f[order], part[order]
        out = [(p, blocks.pack(h[i:j]), blocks.pack_counts(f[i:j])) for p, i, j in blocks.spans(part.astype(np.int64))]
        return pd.DataFrame(out, columns=["slice", "hashes", "counts"])

    found = chunks.mapInPandas(count, "bucket int, slice int, hashes binary, counts binary")
    wanted = materialize(found.groupBy("bucket").applyInPandas(choose, "slice int, hashes binary, counts binary"), "phrase-wanted")

    def spell(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame(columns=["lang", "phrase", "words", "f"])
        h = np.concatenate([blocks.unpack(x) for x in asked["hashes"]])
        f = np.concatenate([blocks.unpack_counts(x) for x in asked["counts"]])
        order = np.argsort(h)
        h, f = h[order], f[order]
        open_, out = np.ones(len(h), bool), []
        for words, lang, found in _phrases(rows, max_words, period):
            data = words.data.tobytes()
            for k, own, _, at in found:
                own, one = np.unique(own, return_index=True)
                place = np.minimum(np.searchsorted(h, own), len(h) - 1)
                hit = np.flatnonzero((h[place] == own) & open_[place])
                open_[place[hit]] = False
                for n, a in zip(f[place[hit]].tolist(), at[one[hit]].tolist()):
                    phrase = b" ".join(data[s:e] for s, e in zip(words.starts[a:a + k].tolist(), words.ends[a:a + k].tolist()))
                    out.append((lang[a], phrase.decode(), k, n))
        return pd.DataFrame(out, columns=["lang", "phrase", "words", "f"])

    return chunks.groupBy("slice").cogroup(wanted.groupBy("slice")).applyInPandas(spell, "lang string, phrase string, words int, f long")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside_share: tuple[int, int] = (50, 100), top: int = 2000,
                 lang_col: str = "lang", text_col: str = "text", period: int = PERIOD) -> DataFrame:
    """The best phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts (A-Z lower-cased) are split at ``. , ; : ! ?`` and line ends into pieces, those at spaces and tabs into words.
    Phrases of 2 to ``max_words`` words with ``a >= min_count`` occurrences inside pieces are candidates; their score is
    the smallest of ``floor(1000000 * a * a / (l * r))`` over all cuts in two parts (ties: the earliest cut). One that
    lies inside a longer candidate of at least ``inside_share`` of its occurrences is dropped. Ranked by score, a (both
    descending) and phrase.

    Null and empty texts have no words; a null language is ``und``, together with that name itself; repeated rows count
    each time; an empty table gives no rows. Only the language and text columns are read. Phrases are counted by 64-bit
    hashes. Products stay exact up to 38 digits (some 10^15 occurrences).
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    slices = size // SLICE_BYTES + 1
    chunks = materialize(dictionary(docs, max_words - 1, slices, period, lang_col, text_col), "phrase-chunks")
    known = materialize(frequent_phrases(chunks, max_words, min_count, slices, period), "phrase-frequent")
    parts = known.filter("words > 0").select("lang", "phrase", "f")
    long = F.split("phrase", " ")
    cand = known.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cut = cand.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("*", F.array_join(F.slice(long, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(long, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.expr("p div q")
    cut = cut.withColumn("p", F.lit(1000000).cast("decimal(7,0)") * (wide["a"] * wide["a"])).withColumn("q", wide["l"] * wide["r"]).withColumn("score", score)
    best = cut.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    inside = cand.filter("words > 2").select("lang", "words", "a", long.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("len"))
    inside = inside.select("lang", "a", "w", "len", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("len") + 1)).alias("i"))
    inside = inside.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    num, den = inside_share
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * den < F.col("a") * num))
    kept = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))  # the best of each part, then of those
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = known.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
