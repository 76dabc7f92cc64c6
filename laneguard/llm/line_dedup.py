"""Line dedup: a segment-partition join under edit distance.

Two lines within t edits agree in one of t + 1 segments of the shorter one, near its place. Lines meet in buckets of
(shorter length, segment number, segment content); which substrings of the longer line can match is narrowed by
position. Candidates are verified by a banded bit-parallel edit distance, and lines linked directly or over others are
one class, of which the first occurrence stays.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from laneguard.llm.linkage import KEY_BLOCKS, TASK_KEYS, key_blocks, link_buckets
from laneguard.llm.words import PrefixHash, mix
from laneguard.session import materialize

EDITS = 2
MIN_CHARS = 24
"""Shorter lines are compared exactly: two edits would change too much of them."""
CHUNK = 1 << 18
"""Characters of the texts that are cut into lines at a time: their arrays stay in the processor's cache."""
BAG = 32
"""Counts of code points (by their last bits) that bound the edit distance from below."""
_SPACE = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)


class Lines:
    """Lines (between line feeds) of some texts as ranges of one array of code points."""

    def __init__(self, texts: list[str]):
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = np.flatnonzero(self.codes == 10)
        self.starts, self.ends = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(self.codes)]))
        counts = np.array([t.count("\n") + 1 for t in texts])
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.pos = np.arange(len(self.starts)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.hash = PrefixHash(self.codes)
        self.ids = (self.hash.of(self.starts, self.ends) >> np.uint64(1)).view(np.int64)

    @cached_property
    def blank(self) -> np.ndarray:
        ink = np.concatenate(([0], np.cumsum(~np.isin(self.codes, _SPACE))))
        return ink[self.ends] == ink[self.starts]


def _line_chunks(texts):
    """(index of the first text, Lines) over whole texts, some at a time; a null text is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > CHUNK:
            yield first, Lines(held)
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, Lines(held)


def segment_keys(lines: Lines, at: np.ndarray, edits: int, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, line index) for the lines ``at``: own segments, and substrings that may equal those of shorter lines."""
    start, length = lines.starts[at], lines.ends[at] - lines.starts[at]
    keys, owner, parts = [], [], edits + 1
    for less in range(edits + 1):
        n = length - less
        base, extra = n // parts, n % parts
        for i in range(1, parts + 1):
            size = base + (i > parts - extra)
            p = (i - 1) * base + np.maximum(0, i - 1 - (parts - extra))
            salt = mix(n.astype(np.uint64), i)
            for shift in range(max(-(i - 1), less - (parts - i)), min(i - 1, less + parts - i) + 1):
                s = p + shift
                ok = (n >= min_chars) & (s >= 0) & (s + size <= length)
                h = lines.hash.of(start[ok] + s[ok], start[ok] + s[ok] + size[ok])
                keys.append(mix(h + salt[ok]))
                owner.append(at[ok])
    return np.concatenate(keys).view(np.int64), np.concatenate(owner)


def within_edits(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Whether each pair is within ``edits`` edits: the banded bit-parallel recurrence on all pairs at once.

    Pairs whose counts of characters differ too much are left out before: an edit changes two of them by one at most. Bit b of a pair's word stands for pattern row j - edits + b in column j, so the band moves down with each
    column; the distance is followed along the lowest diagonal and then along the last row.
    """
    out = np.zeros(len(left), bool)
    sizes = np.array([[len(x), len(y)] for x, y in zip(left, right)]).reshape(-1, 2)
    fits = np.flatnonzero((np.abs(sizes[:, 0] - sizes[:, 1]) <= edits) & (sizes.min(axis=1) > edits))
    for i in np.flatnonzero(sizes.min(axis=1) <= edits):
        out[i] = _plain_distance(left[i], right[i]) <= edits
    fits = fits[_bag_gaps([left[i] for i in fits], [right[i] for i in fits]) <= 2 * edits]
    fits = fits[np.argsort(sizes[fits, 0], kind="stable")]
    lo = 0
    while lo < len(fits):
        hi = lo + 1
        while hi < len(fits) and (hi - lo + 1) * sizes[fits[hi], 0] <= 1 << 20:
            hi += 1
        part = fits[lo:hi]
        out[part] = _banded([left[i] for i in part], [right[i] for i in part], edits)
        lo = hi
    return out


def _bag_gaps(left: list[str], right: list[str]) -> np.ndarray:
    """Of each pair, how much the two differ in their counts of code points, summed."""
    at: dict[str, int] = {}  # a line may be in many pairs
    x, y = (np.array([at.setdefault(t, len(at)) for t in texts], np.int64) for texts in (left, right))
    codes = np.frombuffer("".join(at).encode("utf-32-le", "surrogatepass"), np.uint32) % BAG
    of = np.repeat(np.arange(len(at)), [len(t) for t in at])
    bags = np.bincount(of * BAG + codes, minlength=len(at) * BAG).astype(np.int32).reshape(-1, BAG)
    return np.abs(bags[x] - bags[y]).sum(axis=1)


def _plain_distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def _padded(texts: list[str], before: int, width: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.uint32)
    for i, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, before:before + len(c)] = c
    return out


def _banded(left: list[str], right: list[str], edits: int) -> np.ndarray:
    n1, n2 = np.array([len(x) for x in left]), np.array([len(y) for y in right])
    w, columns = 2 * edits + 1, int(n2.max())
    pattern = _padded(left, edits, columns + w + edits, 0xFFFFFFFF)
    text = _padded(right, 0, columns, 0xFFFFFFFE)
    full, top = np.uint64((1 << w) - 1), np.uint64(w - 1)
    weights, one = np.uint64(1) << np.arange(w, dtype=np.uint64), np.uint64(1)
    vp = np.full(len(left), ((1 << w) - 1) & ~((1 << edits) - 1), np.uint64)
    vn = np.zeros(len(left), np.uint64)
    dist = np.full(len(left), edits, np.int64)
    for j in range(1, columns + 1):
        x = ((pattern[:, j - 1:j - 1 + w] == text[:, j - 1:j]) * weights).sum(axis=1, dtype=np.uint64)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        row = np.clip(n1 - j + edits, 0, w - 1).astype(np.uint64)
        step = np.where(j <= n1 - edits, 1 - ((d0 >> top) & one).astype(np.int64), ((hp >> row) & one).astype(np.int64) - ((hn >> row) & one).astype(np.int64))
        dist += np.where(j <= n2, step, 0)
        vp, vn = (hn | ~((d0 >> one) | hp)) & full, (d0 >> one) & hp
    return dist <= edits


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns with near-duplicate lines taken out of the text, and ``n_lines``, ``n_removed``.

    Lines lie between line feeds. Equal lines, and lines of ``min_chars`` or more code points that are linked within
    ``edits`` edits, are one class; the occurrence with the smallest (id, line number) stays. Lines of white space only
    always stay. Null text stays null with 0 lines; empty text has one blank line. Rows with a null id lose nothing and
    take nothing from others; repeated rows with the same id do not remove each other's lines. An empty table gives no
    rows. Columns named like the two counts are replaced; others do not matter. Lines are told apart by 63-bit hashes
    and compared as text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")

    def occurrences(batches):
        for batch in batches:
            doc = batch["doc_id"].to_numpy()
            for first, lines in _line_chunks(batch["text"]):
                at = np.flatnonzero(~lines.blank)
                yield pd.DataFrame({"doc_id": doc[first + lines.text[at]], "pos": lines.pos[at], "sid": lines.ids[at], "size": (lines.ends - lines.starts)[at]})

    def key_rows(batches):
        def keys():
            for batch in batches:
                for _, lines in _line_chunks(batch["text"]):
                    at = np.flatnonzero(~lines.blank & (lines.ends - lines.starts >= min_chars))
                    at = at[np.unique(lines.ids[at], return_index=True)[1]]
                    own, owner = segment_keys(lines, at, edits, min_chars)
                    yield own.view(np.uint64), lines.ids[owner]

        yield from key_blocks(keys(), buckets)

    found = materialize(rows.mapInPandas(occurrences, "doc_id long, pos long, sid long, size long"), "line-occurrences")
    firsts = found.groupBy("sid").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts, "line-firsts")

    def lines_of(chain: DataFrame) -> DataFrame:
        need = chain.select(F.col("a").alias("sid")).unionAll(chain.select(F.col("b").alias("sid"))).distinct().join(firsts, "sid")
        need = materialize(need.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_set("sid").alias("wanted")), "line-need")

        def take(batches):
            for batch in batches:
                texts, wanted = batch["text"].tolist(), batch["wanted"].tolist()
                for first, lines in _line_chunks(texts):
                    for i in range(lines.text[-1] + 1):
                        own = slice(*np.searchsorted(lines.text, [i, i + 1]))
                        hit = np.flatnonzero(np.isin(lines.ids[own], np.asarray(wanted[first + i])))
                        parts = texts[first + i].split("\n")
                        if len(hit):
                            yield pd.DataFrame({"sid": lines.ids[own][hit], "line": [parts[h] for h in hit]})

        return materialize(rows.join(need.hint("merge"), "doc_id").mapInPandas(take, "sid long, line string").dropDuplicates(["sid"]), "line-texts")

    def near(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        return within_edits(a["line"].tolist(), b["line"].tolist(), edits)

    keys_of_line = sum(min(edits, i - 1 + less) + 1 for less in range(edits + 1) for i in range(1, edits + 2))  # at most
    buckets = firsts.count() * keys_of_line // TASK_KEYS + 1
    classes = link_buckets(rows.mapInPandas(key_rows, KEY_BLOCKS), lines_of, near)
    classes = materialize(classes.select(F.col("node").alias("sid"), "component"), "line-classes")
    merged = firsts.join(classes, "sid").groupBy("component").agg(F.min("first").alias("keep"))
    merged = classes.join(merged, "component").select("sid", "keep")
    dups = firsts.join(merged, "sid", "left").filter("n > 1 or keep is not null").select("sid", F.coalesce("keep", "first").alias("keep"))
    gone = found.join(dups, "sid").filter((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("pos") != F.col("keep.pos")))
    gone = materialize(gone.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "sid")).alias("gone")), "line-gone")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("gone.pos").alias("__pos"), F.col("gone.sid").alias("__sid"))
    counts = ("n_lines", "n_removed")
    kept_columns = [c for c in docs.columns if c not in counts]

    def strip(batches):
        for batch in batches:
            texts, pos, sid = (batch.column(c).to_pylist() for c in (text_col, "__pos", "__sid"))
            n_lines, n_removed, out = [], [], []
            named = [i for i, (t, p) in enumerate(zip(texts, pos)) if t is not None and p]
            lost_of = {}
            for first, lines in _line_chunks([texts[i] for i in named]):
                bounds = np.searchsorted(lines.text, np.arange(lines.text[-1] + 2)).tolist()
                ids = lines.ids.tolist()
                for i, lo, hi in zip(named[first:], bounds, bounds[1:]):
                    lost_of[i] = {k for k, x in zip(pos[i], sid[i]) if lo + k < hi and ids[lo + k] == x}
            for i, t in enumerate(texts):
                parts = [] if t is None else t.split("\n")
                lost = lost_of.get(i, ())
                n_lines.append(len(parts))
                n_removed.append(len(lost))
                out.append(t if not lost else "\n".join(x for k, x in enumerate(parts) if k not in lost))
            arrays = [pa.array(out, pa.string()) if c == text_col else batch.column(c) for c in kept_columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=[*kept_columns, *counts])

    # what is removed grows with the texts: the join is the same at every size
    joined = docs.select(*kept_columns).join(gone.hint("merge"), F.col(id_col) == F.col("__id"), "left").drop("__id")
    schema = StructType([*docs.select(*kept_columns).schema.fields, *[StructField(c, LongType()) for c in counts]])
    return joined.mapInArrow(strip, schema)
