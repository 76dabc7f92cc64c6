"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes, word lengths, repetition and form, each cut
into bins; the bins of the line before and after count too. Documents' labels serve as labels of all their lines in
training. A document's score is the mean of its lines' forward-backward marginals, weighted by line length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from laneguard.llm.line_dedup import Lines, _line_chunks
from laneguard.llm.words import mix

SAMPLE_DOCS = 4_000
"""Most labelled documents that the field is fitted on (those with the smallest hash of their id)."""
SAMPLE_LINES = 150_000
"""Of these, documents are used in that order until they have so many lines."""
STEPS, RATE, RIDGE = 250, 0.08, 1e-3
EDGES = (0.02, 0.1, 0.3, 0.6, 0.9, 0.97)
BINS = len(EDGES) + 1
"""Features are cut at these quantiles of the sample; bad lines are rare, so the tails are fine."""
FEATURES = ("length", "letters", "digits", "upper", "space", "bang", "bar", "marks", "symbols", "word", "longest", "repeats", "distinct", "closed", "known")
_OTHER, _LETTER, _DIGIT, _BLANK, _BANG, _BAR, _MARK = range(7)


def _tables(size: int = 0x3000) -> tuple[np.ndarray, np.ndarray]:
    """Class and upper case of the first code points; those beyond count as letters."""
    kind, upper = np.zeros(size + 1, np.uint8), np.zeros(size + 1, bool)
    for i in range(size):
        c = chr(i)
        kind[i] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _BLANK if c.isspace() else _BANG if c == "!" else _BAR if c == "|" else _MARK if c in ".,;:?'\"()-¿¡«»" else _OTHER
        upper[i] = c.isupper()
    kind[size] = _LETTER
    return kind, upper


_KIND, _UPPER = _tables()


def line_features(lines: Lines) -> np.ndarray:
    """One row per line, one column per feature of ``FEATURES``."""
    code = np.minimum(lines.codes, len(_KIND) - 1)
    kind = _KIND[code]
    n = (lines.ends - lines.starts).astype(float)
    some = np.maximum(n, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return (total[lines.ends] - total[lines.starts]).astype(float)

    count = {k: share(kind == k) for k in range(7)}
    turns = np.flatnonzero(np.diff(np.concatenate(([1], (kind == _BLANK).astype(np.int8), [1]))))
    starts, ends = turns[0::2], turns[1::2]
    of = np.searchsorted(lines.starts, starts, "right") - 1
    words = np.bincount(of, minlength=len(n)).astype(float)
    longest = np.zeros(len(n))
    np.maximum.at(longest, of, ends - starts)
    repeats = distinct = np.zeros(len(n))
    if len(starts):
        h = lines.hash.of(starts, ends)
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])))
        repeats = np.bincount(of, again, len(n))
        # a word is counted once per line
        _, first = np.unique(mix(h + mix(of.astype(np.uint64), 3)), return_index=True)
        distinct = np.bincount(of[first], minlength=len(n)).astype(float)
    last = np.where(n > 0, kind[np.maximum(lines.ends - 1, 0)] if len(kind) else 0, _BLANK)
    _, back, copies = np.unique(mix(lines.ids.view(np.uint64) + mix(lines.text.astype(np.uint64), 4)), return_inverse=True, return_counts=True)
    letters, w = np.maximum(count[_LETTER], 1), np.maximum(words, 1)
    return np.stack([np.log1p(n), count[_LETTER] / some, count[_DIGIT] / some, share(_UPPER[code]) / letters, count[_BLANK] / some, count[_BANG] / some, count[_BAR] / some,
                     count[_MARK] / some, count[_OTHER] / some, np.log1p((n - count[_BLANK]) / w), np.log1p(longest), repeats / w, distinct / w, (last == _MARK).astype(float),
                     (copies[back] > 1).astype(float)], axis=1)


class Field:
    """Weights of the bins of a line and of its neighbours (3 x features x bins), a bias and 2 x 2 transitions."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.weights = np.zeros((3, len(edges), BINS))
        self.bias, self.turns = 0.0, np.zeros((2, 2))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)

    def odds(self, bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log-odds for good of each line by its features; ``first`` and ``last`` mark the ends of documents."""
        own, before, after = (sum(w[f][bins[:, f]] for f in range(bins.shape[1])) for w in self.weights)
        out = own + self.bias
        out[1:] += np.where(first[1:], 0, before[:-1])
        out[:-1] += np.where(last[:-1], 0, after[1:])
        return out


def marginals(odds: np.ndarray, counts: np.ndarray, turns: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Probability of good of each line by forward-backward, for documents of ``counts`` consecutive lines.

    Documents of similar length are run together. Expected transitions are added to ``pairs`` if it is given.
    """
    out = np.zeros(len(odds))
    begin = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    t = np.exp(turns - turns.max())
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * counts[order[hi]] <= 1 << 18 and counts[order[hi]] <= 2 * counts[order[lo]] + 8:
            hi += 1
        part, length = order[lo:hi], int(counts[order[hi - 1]])
        at = begin[part][:, None] + np.arange(length)
        there = np.arange(length) < counts[part][:, None]
        s = np.clip(odds[np.where(there, at, 0)], -60, 60)
        e = np.stack([1 / (1 + np.exp(s)), 1 / (1 + np.exp(-s))], axis=2)  # bad, good
        f, b = np.zeros((length, len(part), 2)), np.ones((length, len(part), 2))
        f[0] = e[:, 0]
        for i in range(1, length):
            a = (f[i - 1] @ t) * e[:, i]
            f[i] = np.where(there[:, i, None], a / a.sum(axis=1, keepdims=True), f[i - 1])
        for i in range(length - 2, -1, -1):
            a = (b[i + 1] * e[:, i + 1]) @ t.T
            b[i] = np.where(there[:, i + 1, None], a / a.sum(axis=1, keepdims=True), b[i + 1])
        p = f * b
        p = (p[:, :, 1] / p.sum(axis=2)).T
        out[at[there]] = p[there]
        if pairs is not None:
            for i in range(1, length):
                joint = f[i - 1][:, :, None] * t[None] * (e[:, i] * b[i])[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                pairs += joint[there[:, i]].sum(axis=0)
        lo = hi
    return out


def fit_field(features: list[np.ndarray], labels: list[int], steps: int = STEPS) -> Field:
    """Maximum conditional likelihood with a small ridge, by adaptive gradient steps over all given documents."""
    if not features:
        return Field([np.zeros(0)] * len(FEATURES))
    x = np.concatenate(features)
    counts = np.array([len(f) for f in features])
    quantiles = [np.unique(np.quantile(x[:, f], EDGES)) for f in range(x.shape[1])]
    field = Field(quantiles)
    bins, y = field.bins(x), np.repeat(np.array(labels), counts)
    ends = np.cumsum(counts)
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    first[ends - counts], last[ends - 1] = True, True
    flat = bins + np.arange(bins.shape[1]) * BINS
    seen = np.zeros((2, 2))
    for label, n in zip(labels, counts):
        seen[label, label] += n - 1
    size = 3 * len(FEATURES) * BINS
    theta, m, v = np.zeros(size + 5), np.zeros(size + 5), np.zeros(size + 5)
    for step in range(1, steps + 1):
        field.weights, field.bias, field.turns = theta[:size].reshape(3, -1, BINS), theta[size], theta[size + 1:].reshape(2, 2)
        pairs = np.zeros((2, 2))
        gap = y - marginals(field.odds(bins, first, last), counts, field.turns, pairs)
        grads = []
        for g in (gap, np.append(np.where(first[1:], 0, gap[1:]), 0), np.append(0, np.where(last[:-1], 0, gap[:-1]))):
            grads.append(np.bincount(flat.ravel(), np.repeat(g, bins.shape[1]), len(FEATURES) * BINS))
        grad = np.concatenate([*grads, [gap.sum()], (seen - pairs).ravel()]) / len(x) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    field.weights, field.bias, field.turns = theta[:size].reshape(3, -1, BINS), theta[size], theta[size + 1:].reshape(2, 2)
    return field


def score_lines(field: Field, lines: Lines) -> np.ndarray:
    """Score of each text of ``lines``: marginals weighted by line length plus 1."""
    counts = np.bincount(lines.text)
    first = lines.pos == 0
    p = marginals(field.odds(field.bins(line_features(lines)), first, np.append(first[1:], True)), counts, field.turns)
    weight = (lines.ends - lines.starts) + 1.0
    return np.bincount(lines.text, p * weight) / np.bincount(lines.text, weight)


def held_out(doc_id):
    """Rows that no model is fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field fitted on a bounded sample of labelled documents that are not held out.

    Labels that are null or neither 0 nor 1 and labels without a document are not used; of repeated ids one row is.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")  # at most sample_docs rows

    def describe(batches):
        for batch in batches:
            for doc, text, y in zip(batch["doc_id"], batch["text"], batch["quality"]):
                x = line_features(Lines([text or ""]))[:sample_lines].astype(np.float32)
                yield pd.DataFrame({"doc_id": [doc], "quality": [y], "n": [len(x)], "x": [x.tobytes()]})

    seen: set[int] = set()
    features, ys, total = [], [], 0
    ordered = texts.mapInPandas(describe, "doc_id long, quality int, n long, x binary").orderBy(F.xxhash64("doc_id"), "doc_id")
    for r in ordered.toLocalIterator():
        if r["doc_id"] in seen or total + r["n"] > sample_lines:
            continue
        seen.add(r["doc_id"])
        total += r["n"]
        features.append(np.frombuffer(r["x"], np.float32).reshape(r["n"], -1).astype(float))
        ys.append(r["quality"])
    return fit_field(features, ys)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, and ``score`` (0 to 1, higher: good) and ``predicted`` (1 from the threshold on).

    Only the text is an input of the score. Null text is scored like empty text, which is one blank line. Null ids and
    repeated rows are scored like any other. Without usable labels every score is 0.5. An empty table gives no rows.
    Input columns named like the two results are replaced.
    """
    field = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    results = ("score", "predicted")
    kept = [c for c in docs.columns if c not in results]

    def score(batches):
        for batch in batches:
            parts = [score_lines(field, lines) for _, lines in _line_chunks(t.as_py() for t in batch.column(text_col))]
            s = np.clip(np.concatenate(parts), 0, 1) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*kept, *results])

    rows = docs.select(*kept)
    return rows.mapInArrow(score, StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
