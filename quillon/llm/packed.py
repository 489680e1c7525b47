"""Columns of numbers as compressed bytes, for rows that hold many values of a task."""

from __future__ import annotations

import numpy as np
import zstandard


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on, by bytes of like weight."""
    out = []
    for x in columns:
        raw = np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)
        wide = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        out.append(np.array([len(x), wide], "<u4").tobytes() + np.ascontiguousarray(raw[:, :wide].T).tobytes())
    return zstandard.compress(b"".join(out), 1)


def unsqueezed(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    out, at = [], 0
    while at < len(data):
        n, wide = np.frombuffer(data, "<u4", 2, at).tolist()
        raw = np.zeros((n, 8), dtype=np.uint8)
        raw[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at + 8).reshape(wide, n).T
        out.append(raw.reshape(-1).view("<u8").astype(np.uint64))
        at += 8 + n * wide
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sequence that does not fall."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


def slices(key: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first, end) of each run of an ordered array."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return list(zip(key[first].tolist(), first.tolist(), [*first[1:].tolist(), len(key)], strict=True)) if len(key) else []
