"""Substring dedup: matching statistics against suffix automata of shared passages.

A window of ``window`` words has the same smallest hash of ``ANCHOR`` words (its anchor) wherever it occurs, so only
windows around anchors that several texts share can repeat. These stretches of words, once per content, are dealt by
anchor to shards. A shard builds suffix automata of its stretches, each over some anchors and at most twice
``SHARD_STRETCHES * STRETCH_WORDS`` words, streams every stretch through its own and reads off, window by window, the
smallest document in which the window starts. An anchor with more words than that is not given to a shard: its single
windows are grouped instead, with partial sums before the shuffle. Shards meet their stretches by a shuffle instead of a
broadcast of every shard to every task, which would grow with the square of the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneguard.llm.words import PrefixHash, Words, chunks, mix
from laneguard.session import materialize

ANCHOR = 5
SHARD_STRETCHES = 4_000
"""Stretches in one shard, on average."""
STRETCH_WORDS = 20
"""Words of a usual stretch. An anchor with more than ``SHARD_STRETCHES`` times as many is split by its windows."""


def _window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` consecutive values, by doubling."""
    done, out = 1, values
    while done < size:
        step = min(done, size - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _texts(raws, window: int, k: int):
    """(index, words, anchor of each window, first word, end, identity of the word sequence) of every text."""
    for first, part in chunks(raws):
        words = Words(part, lower=False)
        anchors, whole = _window_minima(mix(words.grams(k), 41), window - k + 1), PrefixHash(words.hashes)
        ids = (whole.of(words.bounds[:-1], words.bounds[1:]) >> np.uint64(1)).view(np.int64)
        for i in range(len(part)):
            a, b = int(words.bounds[i]), int(words.bounds[i + 1])
            yield first + i, words, anchors[a:max(a, b - window + 1)], a, b, int(ids[i])


class Automaton:
    """Suffix automaton over word sequences; every state knows the smallest document of its occurrences."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [1 << 62]

    def _state(self, length: int, edges: dict, link: int, doc: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.doc.append(doc)
        return len(self.next) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """A copy of q that is reached over p with the length that follows from it."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.doc[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[str], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0, 1 << 62), last
                while p != -1 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p != -1:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            self.doc[last] = min(self.doc[last], doc)

    def close(self) -> None:
        """Passes the smallest document from longer to shorter suffixes."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.doc[s] < self.doc[p]:
                self.doc[p] = self.doc[s]

    def earliest(self, words: list[str], window: int) -> list[int]:
        """Smallest document of each window of the words, from the matching statistic at its last word."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while self.length[self.link[state]] >= window if state else False:
                state = self.link[state]
                matched = self.length[state]
            if i >= window - 1:
                out.append(self.doc[state] if matched >= window else 1 << 62)
        return out


def _by_windows(contents: DataFrame, window: int) -> DataFrame:
    """``uid, earliest`` of contents ``(uid, content, doc, last)`` as automata give them, by grouping equal windows."""
    cut = materialize(contents.select("uid", "doc", "last", F.split("content", " ").alias("words")), "repeat-hot-words")
    single = F.transform(F.sequence(F.lit(0), F.size("words") - window), lambda i: F.array_join(F.slice("words", i + 1, F.lit(window)), " "))
    cut = cut.select("uid", "doc", "last", F.posexplode(single).alias("i", "win"))
    first = materialize(cut.groupBy("win").agg(F.min("doc").alias("d")), "repeat-hot-windows")
    by_uid = cut.join(first, "win").groupBy("uid", "last").agg(F.sort_array(F.collect_list(F.struct("i", "d"))).alias("at"))
    return by_uid.filter(F.exists("at", lambda x: x["d"] < F.col("last"))).select("uid", F.col("at.d").alias("earliest"))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` of every row: words inside a window that also starts in a document with a
    smaller id are removed. ``kept`` joins the words left by one space.

    Windows are judged on the input. Null and empty texts have no words. Rows with a null id lose nothing and take
    nothing from others; repeated rows with the same id do not remove each other's words. An empty table gives no
    rows. Only the id and text columns are read. Windows are compared word by word, whole copies by a 63-bit hash.
    """
    k = min(ANCHOR, window)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def describe(batches):
        for batch in batches:
            tid, n, anchors = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [None] * len(batch)
            for i, _, own, a, b, ident in _texts(batch["text"].tolist(), window, k):
                tid[i], n[i], anchors[i] = ident, b - a, np.unique(own).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "tid": tid, "n": n, "anchors": anchors})

    seen = materialize(rows.mapInPandas(describe, "doc_id long, tid long, n long, anchors array<long>"), "repeat-texts")
    copies = seen.select("doc_id", "tid", "n")
    first = materialize(copies.filter((F.col("n") >= window) & F.col("doc_id").isNotNull()).groupBy("tid").agg(F.min("doc_id").alias("first")), "repeat-first")
    # an anchor is shared if a neighbour in the order by text has the same one; copies of a text count once
    order = Window.partitionBy("anchor").orderBy("tid")
    held = seen.filter(F.col("doc_id").isNotNull()).select("tid", F.explode("anchors").alias("anchor"))
    near = held.withColumn("before", F.lag("tid").over(order)).withColumn("after", F.lead("tid").over(order))
    shared = near.filter((F.col("before") != F.col("tid")) | (F.col("after") != F.col("tid"))).select("tid", "anchor")
    shared = materialize(shared.groupBy("tid").agg(F.collect_set("anchor").alias("anchors")), "repeat-anchors")
    asked = shared.join(first, "tid").select(F.col("first").alias("doc_id"), F.col("tid").alias("want"), "anchors")

    def cut(batches):
        """Stretches of words whose windows have a shared anchor: their content and where they start."""
        for batch in batches:
            out = []
            doc, want, anchors = batch["doc_id"].tolist(), batch["want"].tolist(), batch["anchors"].tolist()
            for i, words, own, a, b, ident in _texts(batch["text"].tolist(), window, k):
                if not len(own) or ident != want[i]:
                    continue
                new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                ends = np.append(new[1:], len(own))
                ok = np.isin(own[new].view(np.int64), np.asarray(anchors[i]))
                for s, e in zip(new[ok].tolist(), ends[ok].tolist()):
                    lo, hi = a + s, a + e - 1 + window
                    text = b" ".join(words.buffer[x:y] for x, y in zip(words.starts[lo:hi].tolist(), words.ends[lo:hi].tolist()))
                    out.append((doc[i], s, int(own[s:s + 1].view(np.int64)[0]), text.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "at", "anchor", "content"])

    stretches = rows.join(asked, "doc_id").mapInPandas(cut, "doc_id long, at long, anchor long, content string")
    stretches = materialize(stretches.withColumn("uid", F.xxhash64("anchor", "content")), "repeat-stretches")
    contents = materialize(stretches.groupBy("anchor", "uid", "content").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last")), "repeat-contents")
    limit = SHARD_STRETCHES * STRETCH_WORDS
    n_words = F.size(F.split("content", " "))
    hot = contents.groupBy("anchor").agg(F.sum(n_words).alias("words")).filter(F.col("words") > limit).select("anchor")
    hot = materialize(hot, "repeat-hot")
    cold = contents.join(hot, "anchor", "left_anti")
    shards = max(1, contents.count() // SHARD_STRETCHES)

    def match(part: pd.DataFrame) -> pd.DataFrame:
        # equal windows have the same anchor, so an automaton may end with any anchor
        part = part.sort_values("anchor", ignore_index=True)
        texts = [t.split(" ") for t in part["content"]]
        anchor, docs_, lasts, uids = (part[c].tolist() for c in ("anchor", "doc", "last", "uid"))
        uid, earliest, lo = [], [], 0
        while lo < len(texts):
            automaton, words, hi = Automaton(), 0, lo
            while hi < len(texts) and (words < limit or anchor[hi] == anchor[hi - 1]):
                automaton.add(texts[hi], docs_[hi])
                words, hi = words + len(texts[hi]), hi + 1
            automaton.close()
            for i in range(lo, hi):
                found_at = automaton.earliest(texts[i], window)
                if min(found_at) < lasts[i]:
                    uid.append(uids[i])
                    earliest.append(found_at)
            lo = hi
        return pd.DataFrame({"uid": np.array(uid, np.int64), "earliest": pd.Series(earliest, dtype=object)})

    found = cold.withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit(9)), F.lit(shards))).groupBy("shard").applyInPandas(match, "uid long, earliest array<long>")
    if not hot.isEmpty():
        found = found.unionAll(_by_windows(contents.join(hot, "anchor", "left_semi"), window))
    hits = stretches.select("doc_id", "at", "uid").join(found, "uid")
    windows = F.filter(F.transform("earliest", lambda d, i: F.when(d < F.col("doc_id"), F.col("at") + i)), lambda x: x.isNotNull())
    spans = hits.select("doc_id", windows.alias("windows")).filter(F.size("windows") > 0)
    spans = materialize(spans.groupBy("doc_id").agg(F.flatten(F.collect_list("windows")).alias("windows")), "repeat-windows")
    # the first row of a text carries its windows; a later copy loses everything
    with_copy = copies.filter("doc_id is not null").join(first, "tid").select("doc_id", "tid", (F.col("doc_id") > F.col("first")).alias("copy"))
    with_copy = with_copy.filter("copy").select("doc_id", F.col("tid").alias("copy_of")).unionAll(spans.select("doc_id", F.lit(None).cast("long").alias("copy_of")))
    marks = with_copy.groupBy("doc_id").agg(F.collect_set("copy_of").alias("copies")).join(spans, "doc_id", "left")
    carried = marks.join(shared.join(first, "tid").groupBy(F.col("first").alias("doc_id")).agg(F.collect_set("tid").alias("tids")), "doc_id", "left")

    def strip(batches):
        for batch in batches:
            out = []
            docs_, copies_, tids_, windows_ = (batch[c].tolist() for c in ("doc_id", "copies", "tids", "windows"))
            for i, text in enumerate(batch["text"]):
                raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
                words, gone = raw.split(), None  # bytes are split at exactly the separators
                if copies_[i] is not None:
                    _, _, _, _, n, ident = next(_texts([text], window, window))
                    if n >= window and ident in set(copies_[i]):
                        gone = np.ones(n, bool)
                    elif windows_[i] is not None and tids_[i] is not None and ident in set(tids_[i]):
                        steps = np.zeros(n + 1, np.int64)
                        at = np.asarray(windows_[i], np.int64)
                        at = at[at + window <= n]
                        np.add.at(steps, at, 1)
                        np.add.at(steps, at + window, -1)
                        gone = np.cumsum(steps)[:-1] > 0
                kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])
                out.append((docs_[i], len(words), 0 if gone is None else int(gone.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return rows.join(carried, "doc_id", "left").mapInPandas(strip, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
