"""Sorted 64-bit values as small binary blocks, so that a shuffle moves one row for thousands of them."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as the byte planes of their differences (leading planes are zeros and compress well)."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(block: bytes) -> np.ndarray:
    planes = np.frombuffer(block, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Positive counts in any order, as byte planes of the width that the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width]) + planes.tobytes()


def unpack_counts(block: bytes) -> np.ndarray:
    planes = np.frombuffer(block, np.uint8, offset=1).reshape(block[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :block[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def spans(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the runs of an ascending bucket column."""
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    return list(zip(buckets[first].tolist(), first.tolist(), [*first[1:].tolist(), len(buckets)]))
