"""Distances of all pairs of two sets of vectors of whole numbers, counted in buckets: exact, by products of blocks."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and columns of a block of distances, which a core's cache holds.
ROWS, COLUMNS = 256, 1024
#: Buckets of a block up to which each bound is compared by itself; and the bucket below which bounds are exact squares.
FEW, EXACT = 16, 1 << 17
SCHEMA = "bucket long, n long"


def _matrix(v: pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Values, 0 where there is none, and where there are; None if everywhere."""
    lengths, flat = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64), v.flatten()
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    if not flat.null_count and (lengths == wide).all():
        return values.reshape(len(v), wide), None
    x, there = np.zeros((len(v), wide), np.int64), np.zeros((len(v), wide), bool)
    at = np.repeat(np.arange(len(v)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x[at], there[at] = values, flat.is_valid().to_numpy(zero_copy_only=False)
    return x, there


def _factors(v: list[pa.Array]) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
    """Matrices whose product is the squared distances: (-2a, aa, 1) by (b, 1, bb). Where values are missing, the second
    pair's product counts the places that both have.

    No sum on the way is beyond four times the largest squared length, so with that below 2^24 single floats are exact,
    below 2^53 doubles; beyond, Python's integers.
    """
    wide = max([0, *(pc.max(pc.list_value_length(x)).as_py() or 0 for x in v)])
    both = [_matrix(x, wide) for x in v]
    most = 4 * max([0.0, *((x.astype(float) ** 2).sum(axis=1).max() for x, _ in both if len(x))])
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 52 else object
    a, b = (x.astype(kind) for x, _ in both)
    if all(there is None for _, there in both):
        aa, bb = ((x * x).sum(axis=1, keepdims=True) for x in (a, b))
        return [np.hstack([-2 * a, aa, np.ones_like(aa)]), np.hstack([b, np.ones_like(bb), bb])], None
    m, w = (np.ones(x.shape, kind) if there is None else there.astype(kind) for x, there in both)
    return [np.hstack([-2 * a, a * a, m]), np.hstack([b, w, b * b])], [m.astype(np.float32), w.astype(np.float32)]


def _count(d: np.ndarray, size: int, told: Counter) -> None:
    low, high = (int(np.sqrt(float(x)) / size) for x in (d.min(), d.max()))
    if high - low <= FEW and high < EXACT:
        least = [d.size, *(np.count_nonzero(d >= (size * k) ** 2) for k in range(low + 1, high + 1)), 0]
        told.update({low + k: int(least[k] - least[k + 1]) for k in range(len(least) - 1)})
        return
    buckets, n = np.unique(np.floor(np.sqrt(d.astype(np.float64)) / size).astype(np.int64), return_counts=True)
    told.update(dict(zip(buckets.tolist(), n.tolist(), strict=True)))


def bucket_pairs(a: pa.Table, b: pa.Table | None, size: int = 250) -> pa.Table:
    """Pairs by floor(distance / size), over the places where both vectors have a value; null where there is none.

    Columns are vec_id and v. With b None pairs are those within a. Rows of the same vec_id are no pair.
    """
    sides = [a, a if b is None else b]
    ids = [x["vec_id"].to_numpy() for x in sides]
    same = len(np.unique(ids[0])) < len(ids[0]) if b is None else bool(len(np.intersect1d(*ids)))
    (left, right), common = _factors([x["v"].combine_chunks() for x in sides])
    told: Counter = Counter()
    for i in range(0, len(left), ROWS):
        rows = slice(i, i + ROWS)
        for j in range(i if b is None else 0, len(right), COLUMNS):
            columns = slice(j, j + COLUMNS)
            d = left[rows] @ right[columns].T
            keep = None
            if same:
                keep = ids[0][rows, None] != ids[1][None, columns]
            if b is None and j < i + ROWS:
                after = np.arange(j, j + d.shape[1])[None, :] > np.arange(i, i + d.shape[0])[:, None]
                keep = after if keep is None else keep & after
            if common:
                known = common[0][rows] @ common[1][columns].T > 0
                told[None] += int(np.count_nonzero(~known if keep is None else keep & ~known))
                keep = known if keep is None else keep & known
            d = d if keep is None else d[keep]
            if d.size:
                _count(d, size, told)
    found = [(k, n) for k, n in told.items() if n]
    return pa.table({"bucket": pa.array([k for k, _ in found], pa.int64()), "n": pa.array([n for _, n in found], pa.int64())})
