"""Best-fit packing: a configuration linear program over the length histogram.

Only the histogram (one count per length up to the sequence length) reaches the driver. Lengths are grouped into a few
dozen classes. A configuration is a multiset of classes that fit into one sequence. Multiplicative weights keep a price
per class; the most valuable configuration at these prices comes from a knapsack dynamic program. Whole uses are kept and
filled with pieces, the rest is solved again; the last few pieces are filled greedily. Tasks then place each piece by its
rank among equal lengths.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneguard.session import materialize

STEP = 0.25
"""How much of a class's demand one price update may cover."""
SHARPNESS = 2.0
"""A class that is covered once is priced lower by this power of e."""
OVER = 1.5
"""A class that is covered so often is offered no more."""
CLASSES = 64
"""Classes of lengths in the linear program."""
REST = 0.05
"""Share of the pieces from which on the program is not solved again."""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, object] = {}


def _encoder(name: str):
    """``text -> ids`` for a byte-level BPE file of ``tokenizers``.

    The file's vocabulary is run by tiktoken, which gives the same ids several times faster (tested); texts with a
    special token's string go to ``tokenizers`` itself.
    """
    if name in _ENCODERS:
        return _ENCODERS[name]
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    # fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from code point 256
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if any(t in text for t in special):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    _ENCODERS[name] = encode
    return encode


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of whole texts: ids, then ``end_id``; only longer documents are cut, the first piece is the short one."""

    def cut(batches):
        encode = _encoder(tokenizer)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) if text is not None else []
                ids.append(end_id)
                raw, n = np.array(ids, "<u4"), len(ids)
                first = (n - 1) % max_tokens + 1
                for k, b in enumerate(range(first, n + 1, max_tokens)):
                    a = max(0, b - max_tokens)
                    out.append((doc, k, a, b - a, zlib.crc32(raw[a:b].tobytes())))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(cut, PIECES)


def _classes(left: np.ndarray, classes: int) -> np.ndarray:
    """Largest length of each class, ascending: the lengths that are left, grouped linearly into classes of about equal counts."""
    there = np.flatnonzero(left)
    if len(there) <= classes:
        return there
    above = np.cumsum(left[there][::-1])[::-1]  # pieces of this length or longer
    group = (above - 1) * classes // above[0]
    return there[np.append(group[1:] != group[:-1], True)]


def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """How many pieces of each length the most valuable configuration holds. Pieces of one length are offered in bundles of
    1, 2, 4, ..., so that a bundle is one vector operation over all capacities."""
    best, taken, bundles = np.zeros(capacity + 1), [], []
    for i, length in enumerate(lengths):
        size = 1
        while size * length <= capacity:
            weight = int(size * length)
            with_it = best[:-weight] + size * price[i]
            take = with_it > best[weight:]
            best[weight:][take] = with_it[take]
            bundles.append((i, size, weight))
            taken.append(take)
            size *= 2
    out, w = np.zeros(len(lengths), np.int64), capacity
    for (i, size, weight), take in zip(reversed(bundles), reversed(taken)):
        if w >= weight and take[w - weight]:
            out[i] += size
            w -= weight
    return out


def _fractional(lengths: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Uses of configurations that nearly cover ``need``, by multiplicative weights: ``[(pieces per class, times)]``.

    Each round covers at least one class by ``STEP`` of its need, and a class covered ``OVER`` times is no longer offered, so
    the number of rounds is bounded by the number of classes, and at least 1 / (OVER + STEP) of each use is kept.
    """
    price = lengths.astype(float)  # at first a piece is worth its length
    covered = np.zeros(len(lengths))
    uses: dict[bytes, float] = {}
    while np.any(covered < need):
        config = _knapsack(lengths, np.where(covered < OVER * need, price, 0.0), capacity)
        held = config > 0
        times = STEP * float(np.min(need[held] / config[held]))
        uses[config.tobytes()] = uses.get(config.tobytes(), 0.0) + times
        covered += times * config
        price *= np.exp(-SHARPNESS * times * config / need)
    scale = float(np.min(need / np.maximum(covered, need)))  # no class is used beyond its pieces
    return [(np.frombuffer(c, np.int64), x * scale) for c, x in uses.items()]


def _best_pair(free: np.ndarray, most: int, room: int) -> list[int]:
    """Two pieces that fill the room best, the first no longer than ``most``, of equal pairs that with the longest first; else
    the longest piece that fits, if any."""
    there = np.flatnonzero(free[:room + 1])
    first = there[there <= most]
    at = np.searchsorted(there, room - first, "right") - 1
    at -= (at >= 0) & (there[at] == first) & (free[first] < 2)
    both = np.where(at >= 0, first + there[at], 0)
    if not both.any():
        return there[-1:].tolist()
    i = len(both) - 1 - int(np.argmax(both[::-1]))
    return [int(first[i]), int(there[at[i]])]


def _fill(left: np.ndarray, wanted: list[int], capacity: int) -> list[int]:
    """Lengths of one sequence. For each wanted class the longest piece left that is no longer; the last two fill the room
    best. After them, and without wanted classes, always the longest that still fits."""
    out, room, free = [], capacity, left.copy()
    slots = wanted[:-1] if len(wanted) > 1 else wanted
    for k in range(capacity):
        fits = np.flatnonzero(free[:room + 1])
        if not len(fits):
            break
        most = slots[k] if k < len(slots) else room
        if k + 1 == len(slots) and len(wanted) > 1:
            picked = _best_pair(free, most, room)
        else:
            fits = fits[:max(1, int(np.searchsorted(fits, most, "right")))]
            picked = [int(fits[-1])]
        for length in picked:
            out.append(length)
            free[length] -= 1
            room -= length
    return out


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """``[(lengths of a sequence, how many such sequences)]`` that place exactly the given pieces."""
    return [(config, times) for config, times, _ in _plan(counts, capacity)]


def _plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int, str]]:
    """The plan with the origin of each entry: ``full``, ``program`` (rounded uses of the linear program) or ``rest``.

    Lengths are grouped linearly into classes, each counted at its mean length, so that uses per configuration are large and
    rounding down loses little. What rounding leaves is grouped and solved again, until few pieces (``REST`` of all, or
    fewer than classes) are left. A rounded use, those with the longest pieces first, is filled with exact lengths in bulk:
    one entry lasts until a length or the uses end, so the number of entries does not grow with the counts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[list[int], int, str]] = []

    def use(config: list[int], most: int, origin: str) -> int:
        lengths, n = np.unique(config, return_counts=True)
        times = int(min(most, np.min(left[lengths] // n)))
        plan.append((config, times, origin))
        left[lengths] -= times * n
        return times

    if left[capacity]:
        use([capacity], int(left[capacity]), "full")
    total = left.sum()
    while left.sum() > max(CLASSES, REST * total):
        ends = _classes(left, CLASSES)
        per_class = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)[ends]]))
        need = per_class(left).astype(float)
        lengths = np.ceil(per_class(left * np.arange(capacity + 1)) / need).astype(np.int64)
        took = 0
        for config, x in sorted(_fractional(lengths, need, capacity), key=lambda c: tuple(-c[0][::-1])):
            wanted, uses = np.repeat(ends, config)[::-1].tolist(), int(x)
            while uses > 0 and left.any():
                times = use(_fill(left, wanted, capacity), uses, "program")
                uses -= times
                took += times
        if not took:
            break
    while left.any():
        use(_fill(left, [], capacity), int(left.sum()), "rest")
    return plan


def _ranges(plan: list[tuple[list[int], int]]) -> dict[int, list[np.ndarray]]:
    """Per length: first rank, pieces per sequence, offset of the first such piece, first sequence number."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for config, times in plan:
        offset = 0
        for length, n in sorted(Counter(config).items(), reverse=True):
            rows.setdefault(length, []).append((used[length], n, offset, sequence))
            used[length] += n * times
            offset += n * length
        sequence += times
    return {length: [np.array(c, np.int64) for c in zip(*r)] for length, r in rows.items()}


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", max_tokens: int = 1024, end_id: int = 2,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``max_tokens``:
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are documents of one token, the end id. Rows with a null id and repeated rows are packed
    like any other. An empty table gives no rows. Only the id and text columns are read. What the driver holds is
    bounded by ``max_tokens``: the histogram and a few configurations per length.
    """
    spark = docs.sparkSession
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = materialize(token_pieces(docs, tokenizer, max_tokens, end_id, id_col, text_col), "pack-pieces")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    cells = materialize(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = _ranges(pack_histogram(counts, max_tokens))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("rank", rank).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("rank") - 1)

    def place(batches):
        for batch in batches:
            length, r = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                lo, n, off, seq = ranges[int(value)]
                i = np.searchsorted(lo, r[at], "right") - 1
                turn = r[at] - lo[i]
                sequence[at] = seq[i] + turn // n[i]
                offset[at] = off[i] + turn % n[i] * value
            out = batch[["doc_id", "piece", "start", "length", "ids_crc32"]]
            yield out.assign(doc_id=out["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, PIECES + ", sequence_id long, offset long")
