"""Similarity join of documents on word shingles with parity sketches.

Every shingle of a set toggles (XOR) one bit of a sketch, so the Hamming distance of two sketches is at most the
symmetric difference of the sets. Sets are put into bands of similar size; the largest symmetric difference d of a
link in a band is known, so of more than d sketch chunks one must agree: documents meet in buckets of equal, non-zero
chunks. A folded sketch with about as many bits as the set has shingles screens pairs (a wider one where whole buckets
are compared), whole shingle sets verify them.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneguard.llm.linkage import KEY_BLOCKS, TASK_KEYS, key_blocks, link_buckets
from laneguard.llm.words import Words, chunks, mix, shingle_set
from laneguard.session import materialize

CHUNK_BITS = 1 << 32
"""Places of a sketch chunk. Only its odd bits are held, so it may be wide: in a narrow one different shingles often toggle the same
bit, and buckets of sets that share nothing grow with the table."""
FINE = 8
"""Bits per shingle of the sketch that compares whole buckets; nearly all pairs it lets through are links."""
MAX_SENT_IDS = 1 << 20
"""Document ids (8 bytes each) that are sent to every executor to leave out other texts before their shuffle; with more, all are shuffled."""
SLICE = 1 << 18
"""Shingles of the texts that are compared with one copy of their partner's text, about."""


def _bounds() -> np.ndarray:
    """Least set size of each band; a band is about 1.3 times as wide as the one before."""
    b = [1]
    while b[-1] < 1 << 40:
        b.append(max(b[-1] + 1, -(-b[-1] * 13 // 10)))
    return np.array(b, np.int64)


BOUNDS = _bounds()


def largest_difference(total_size, num: int, den: int):
    """Largest symmetric difference of two sets with ``den * intersection >= num * union`` and sizes adding up to this."""
    return total_size * (den - num) // (den + num)


@lru_cache(maxsize=None)
def _chunks_of(band: int, num: int, den: int) -> tuple[int, int, int]:
    """(chunks, spare chunks, least odd bits of a chunk that is a key) of a band; no chunks where only equal sets are links.

    A chunk with a single odd bit would bring together all documents that share one common phrase, so two are asked for
    where the expected number of lesser chunks leaves room; sets of few shingles take any non-zero chunk.
    """
    d = int(largest_difference(2 * (int(BOUNDS[band + 1]) - 1), num, den))
    if not d:
        return 0, 0, 1
    spare = 0
    while spare <= d:
        mean = int(BOUNDS[band]) / (d + 1 + spare)
        weak = (d + 1 + spare) * (1 + mean) * math.exp(-mean)
        need = math.ceil(weak + 2 * math.sqrt(weak))
        if need <= spare:
            return d + 1 + spare, spare, 2
        spare = need
    spare = 2 + -(-d * 6 // 100)
    return d + 1 + spare, spare, 1


def bucket_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set; two linked, different sets share one of them.

    Of a band's chunks at most d differ, and at most ``spare`` of a set have too few odd bits for a key, so one equal
    key chunk is left. A set with more lesser chunks adds its prefix keys (the classic prefix filter): two such sets
    share one.
    """
    n = len(shingles)
    low, high = np.searchsorted(BOUNDS, [n, n * den // num], "right") - 1
    out, prefix = [], False
    h = mix(shingles, 77)
    for band in range(low, high + 1):
        m, spare, least = _chunks_of(band, num, den)
        if not m:
            continue
        bits, times = np.unique(h % np.uint64(m * CHUNK_BITS), return_counts=True)
        odd = bits[times & 1 == 1]  # bits toggled twice cancel
        chunk = (odd // np.uint64(CHUNK_BITS)).astype(np.int64)
        sketch = np.zeros(m, np.uint64)  # hash of the odd bits of each chunk
        np.bitwise_xor.at(sketch, chunk, mix(odd, 5))
        on = np.flatnonzero(np.bincount(chunk, minlength=m) >= least)
        out.append(mix(sketch[on] ^ mix(on.astype(np.uint64), 1000 + band)))
        prefix |= m - len(on) > spare
    if prefix:
        length = n - -(-num * n // den) + 1
        out.append(mix(np.sort(mix(shingles, 99))[:length], 31337))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> np.ndarray:
    """64-bit identity of a set (never 0)."""
    total = np.sum(mix(shingles, 1), dtype=np.uint64, keepdims=True) + np.bitwise_xor.reduce(mix(shingles, 2), keepdims=True) * np.uint64(3)
    return mix(total + np.uint64(len(shingles)), 3) | np.uint64(1)


def folded(shingles: np.ndarray, times: int = 1) -> bytes:
    """Sketch of the least power of two of bits that is not under ``times`` the set's size (64 at least)."""
    size = max(64, 1 << (times * len(shingles) - 1).bit_length())
    bits = np.bincount((mix(shingles, 31) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _narrowed(sketches, width: int) -> np.ndarray:
    """Sketches of one width as rows of ``width`` 64-bit words; the halves of a wider one are folded by XOR."""
    x = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while x.shape[1] > width:
        x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
    return x


def may_link(a: pd.DataFrame, b: pd.DataFrame, num: int, den: int) -> np.ndarray:
    """Whether sizes and sketches (columns ``n`` and ``sketch``) allow a link of each row of a with that of b."""
    na, nb = a["n"].to_numpy(), b["n"].to_numpy()
    x, y = a["sketch"].to_numpy(), b["sketch"].to_numpy()
    wide = np.stack([[len(v) // 8 for v in s] for s in (x, y)]).astype(np.int64).reshape(2, -1)
    ok, differ = den * np.minimum(na, nb) >= num * np.maximum(na, nb), np.zeros(len(a), np.int64)
    for pair in np.unique(wide[:, ok], axis=1).T:
        at = np.flatnonzero(ok & (wide == pair[:, None]).all(axis=0))
        differ[at] = np.bitwise_count(_narrowed(x[at], pair.min()) ^ _narrowed(y[at], pair.min())).sum(axis=1, dtype=np.int64)
    return ok & (differ <= largest_difference(na + nb, num, den))


def _sets(texts, k: int):
    """(index, shingle set) of every text."""
    for first, raws in chunks(list(texts)):
        words = Words(raws, lower=True)
        grams = words.grams(k)
        for i in range(len(raws)):
            yield first + i, shingle_set(words, grams, i, k)


def ngram_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents linked by ``den * intersection >= num * union`` of their
    distinct k-word shingles (A-Z lower-cased), grouped by reachability.

    Null and empty texts and texts without words have 0 shingles and form groups of their own. Documents with equal
    sets are one item of the join. Rows with a null id link nothing: they get the group of an equal set, else null.
    Repeated rows stay. An empty table gives no rows. Only the id and text columns are read. Shingles are compared by
    64-bit hashes, whole texts by a 64-bit hash of their set.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def describe(batches):
        for batch in batches:
            n, sid, known = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), {}
            sketch, fine = [None] * len(batch), [None] * len(batch)
            for i, s in _sets(batch["text"], k):
                n[i] = len(s)
                if len(s):
                    own = sid[i] = set_id(s).view(np.int64)[0]
                    if own not in known:
                        known[own] = folded(s), folded(s, FINE)
                    sketch[i], fine[i] = known[own]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": n, "sid": sid, "sketch": sketch, "fine": fine})

    def keys_of(batches):
        def found():
            for batch in batches:
                seen = set()
                for _, s in _sets(batch["text"], k):
                    if len(s) and (own := set_id(s).view(np.int64)[0]) not in seen:
                        seen.add(own)
                        keys = bucket_keys(s, num, den)
                        yield keys, np.full(len(keys), own, np.int64)

        yield from key_blocks(found(), buckets)

    sets = materialize(rows.mapInPandas(describe, "doc_id long, n long, sid long, sketch binary, fine binary"), "ngram-sets")
    usable = sets.filter("n > 0 and doc_id is not null")
    reps = materialize(usable.groupBy("sid").agg(F.min("doc_id").alias("rep")), "ngram-reps")
    buckets = (usable.agg(F.sum("n")).first()[0] or 0) // (2 * TASK_KEYS) + 1  # about half as many keys as shingles
    keys = rows.filter("doc_id is not null").mapInPandas(keys_of, KEY_BLOCKS)  # texts are read again: cheaper than to store all keys
    described = materialize(usable.select("sid", "n", "sketch", "fine").dropDuplicates(["sid"]), "ngram-info")
    info, sharp = described.select("sid", "n", "sketch"), described.select("sid", "n", F.col("fine").alias("sketch"))

    def screen(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        return may_link(a, b, num, den)

    def exact(batches):
        hub, of = None, np.zeros(0, np.uint64)  # the sort puts the text of each hub before its partners
        for batch in batches:
            a, sid, first = batch["a"].to_numpy(), batch["sid"].to_numpy(), batch["first"].to_numpy()
            out = []
            for i, s in _sets(batch["text"], k):
                if not len(s) or set_id(s).view(np.int64)[0] != sid[i]:
                    continue  # another row with the same id
                if first[i]:
                    hub, of = a[i], s
                elif hub == a[i]:
                    both = len(np.intersect1d(of, s, assume_unique=True))
                    if den * both >= num * (len(of) + len(s) - both):
                        out.append((a[i], sid[i]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def check(some: DataFrame) -> DataFrame:
        """True links of ``some``: the texts of all partners of a go to slices of a, each with a's own text before them."""
        some = some.join(info.select(F.col("sid").alias("b"), "n"), "b")
        slices = some.groupBy("a").agg(F.ceil(F.sum("n") / SLICE).alias("slices"))
        dealt = some.join(slices, "a").withColumn("slice", F.pmod(F.xxhash64("b"), "slices"))
        ends = dealt.select("a", "slice", F.lit(0).alias("first"), F.col("b").alias("sid")).unionAll(
            slices.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("first"), F.col("a").alias("sid")))
        ends = materialize(ends.join(reps, "sid").withColumnRenamed("rep", "doc_id"), "ngram-ends")
        ids = materialize(ends.select("doc_id").distinct(), "ngram-ids")
        few = ids.count() <= MAX_SENT_IDS  # checked: then only the texts of these ids are shuffled
        wanted = rows.join(F.broadcast(ids), "doc_id", "left_semi") if few else rows
        texts = wanted.join(ends, "doc_id").select("a", "slice", "first", "sid", "text")
        return texts.repartition("a", "slice").sortWithinPartitions("a", "slice", F.desc("first")).mapInPandas(exact, "a long, b long")

    def set_rows(wanted: DataFrame) -> DataFrame:
        """``sid, n, sketch, items``: the whole shingle sets of the wanted ones."""
        def take(batches):
            for batch in batches:
                sid, out = batch["sid"].to_numpy(), []
                for i, s in _sets(batch["text"], k):
                    if len(s) and set_id(s).view(np.int64)[0] == sid[i]:
                        out.append((sid[i], s.tobytes()))
                yield pd.DataFrame(out, columns=["sid", "items"]).astype({"sid": "int64"})

        need = materialize(wanted.join(reps, "sid").select("sid", F.col("rep").alias("doc_id")), "ngram-need")
        whole = rows.join(need, "doc_id").mapInPandas(take, "sid long, items binary").dropDuplicates(["sid"])
        return materialize(whole.join(info, "sid"), "ngram-whole")

    def linked(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        ok = screen(a, b)
        for i in np.flatnonzero(ok):
            x, y = np.frombuffer(a["items"][i], np.uint64), np.frombuffer(b["items"][i], np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = den * both >= num * (len(x) + len(y) - both)
        return ok

    components = materialize(link_buckets(keys, info, screen, lambda _: check, sharp, (set_rows, linked)), "ngram-components")
    group = reps.join(components.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = materialize(group.join(least, "component").select("sid", "component_id"), "ngram-groups")
    out = sets.select("doc_id", "n", "sid").join(of_set, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
