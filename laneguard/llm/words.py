"""Words, shingles and polynomial hashes of whole texts, vectorized over batches of documents.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D`` of the UTF-8 text. All hashes are 64-bit
polynomials modulo 2^64 over bytes or code points, followed by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
"""Texts are hashed in chunks of about so many bytes (one longer text is a chunk of its own)."""
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
        table[0] = 1
        have = _POWERS[base] = np.cumprod(table, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Avalanche of 64-bit values, so that single bits and remainders can be used."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & _MASK)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PrefixHash:
    """Hashes of any slices of one symbol array, each in constant time."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=self.sums[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) of about ``CHUNK_BYTES`` each; a null text is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > CHUNK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


class Words:
    """Words of a chunk of texts: ``bounds[i]:bounds[i+1]`` are those of text i."""

    def __init__(self, raws: list[bytes], lower: bool):
        self.buffer = b"\n".join(raws)
        data = np.frombuffer(self.buffer, np.uint8)
        if lower:
            data = _LOWER[data]
        turns = np.flatnonzero(np.diff(np.concatenate(([1], _SEPARATOR[data].view(np.int8), [1]))))
        self.starts, self.ends = turns[0::2], turns[1::2]
        begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
        self.bounds = np.searchsorted(self.starts, begins)
        self.hashes = PrefixHash(data).of(self.starts, self.ends) if len(data) else np.zeros(0, np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words that start at each word (those near the end of a text are not meaningful)."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += mix(self.hashes[j:j + n], j + 1)
        return mix(total, k)


def shingle_set(words: Words, grams: np.ndarray, i: int, k: int) -> np.ndarray:
    """Distinct k-word shingles of text i; a text of fewer words has its whole sequence as one shingle."""
    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
    if b - a >= k:
        return np.unique(grams[a:b - k + 1])
    if a == b:
        return np.zeros(0, np.uint64)
    total = np.zeros(1, np.uint64)
    for j in range(b - a):
        total += mix(words.hashes[a + j:a + j + 1], j + 1)
    return mix(total, b - a)
