"""Sparse enhanced suffix arrays: ordered suffixes, common prefixes, the interval tree and the repeats that it tells.

The suffixes of an array begin at given places (anchors) of one buffer. Each may read ``right`` bytes from its place on
and ``left`` bytes before it, so bytes of another text are never seen. Places are ordered by what stands to the right,
neighbours' common prefixes form an array, and a stack scan over it gives the nodes of the interval tree. Within a node
the same is done to what stands to the left. A node of this second tree that the left cannot extend for all its places
(they differ there, or one may read no further), and that no single child of the first node holds, is a maximal repeat
with all its places.

All comparisons are of bytes. Buffers need ``PAD`` bytes before the first place and after the last one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

PAD = 64
_KEEP = np.array([0, *(((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 9))], dtype=np.uint64)


class Repeats(NamedTuple):
    """Groups of places that share ``left`` bytes before and ``right`` bytes from the place on; members of one group
    after those of the other, ``count`` of them in each."""

    left: np.ndarray
    right: np.ndarray
    count: np.ndarray
    members: np.ndarray


def word(buf: np.ndarray, place: np.ndarray, size: np.ndarray, k: int, side: int) -> np.ndarray:
    """The k-th eight bytes from each place on (side 1) or before it, read away from it (side -1), as integers that
    compare like the bytes; bytes beyond ``size`` are 0."""
    at = place + 8 * k if side > 0 else place - 8 * (k + 1)
    w = np.ndarray(shape=(len(buf) - 7,), dtype=">u8" if side > 0 else "<u8", buffer=buf, strides=(1,))[at]
    return w.astype(np.uint64) & _KEEP[np.clip(size - 8 * k, 0, 8)]


def words(buf: np.ndarray, place: np.ndarray, size: np.ndarray, side: int) -> list[np.ndarray]:
    return [word(buf, place, size, k, side) for k in range(-(-int(size.max(initial=0)) // 8))]


def common(own: list[np.ndarray], size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bytes that suffixes i and j have in common."""
    out, live = np.zeros(len(i), dtype=np.int64), np.ones(len(i), dtype=bool)
    for w in own:
        x = w[i] ^ w[j]
        same = np.zeros(len(i), dtype=np.int64)
        for k in range(1, 9):
            same += x >> np.uint64(64 - 8 * k) == 0
        out += np.where(live, same, 0)
        live &= x == 0
    return np.minimum(out, np.minimum(size[i], size[j]))


def ordered(own: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    return np.lexsort((size, *own[::-1]))


def prefixes(own: list[np.ndarray], size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours in an order; the first is 0."""
    out = np.zeros(len(order), dtype=np.int64)
    out[1:] = common(own, size, order[:-1], order[1:])
    return out


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (common prefix, first, last) of the interval tree with a prefix of ``least`` or more, by a stack scan."""
    turn = np.flatnonzero(np.diff(np.concatenate([[False], lcp >= least, [False]]).astype(np.int8)))
    start, stop = turn[::2], turn[1::2]
    alone = stop - start == 1  # two neighbours and no more: a node without a scan
    depths, firsts, lasts = [], [], []
    for a, z in zip(start[~alone].tolist(), stop[~alone].tolist(), strict=True):
        deep: list[int] = []
        since: list[int] = []
        for i, now in enumerate(lcp[a:z].tolist(), a):
            left = i - 1
            while deep and deep[-1] > now:
                left = since.pop()
                depths.append(deep.pop()), firsts.append(left), lasts.append(i - 1)
            if not deep or deep[-1] < now:
                deep.append(now), since.append(left)
        while deep:
            depths.append(deep.pop()), firsts.append(since.pop()), lasts.append(z - 1)
    return tuple(np.concatenate([x, np.array(y, dtype=np.int64)]) for x, y in ((lcp[start[alone]], depths), (start[alone] - 1, firsts), (start[alone], lasts)))


def ranges(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """a[0], a[0]+1, ... for n[0] numbers, then a[1] ..."""
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(n)
    return np.arange(ends[-1]) - np.repeat(ends - n - a, n)


def maximal_repeats(buf: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> Repeats:
    """The maximal repeats of ``least`` bytes or more around the places, each with all its places."""
    none = np.zeros(0, dtype=np.int64)
    if len(place) < 2:
        return Repeats(none, none, none, none)
    after, before = words(buf, place, right, 1), words(buf, place, left, -1)
    order = ordered(after, right)
    depth, first, last = intervals(prefixes(after, right, order), max(1, least - int(left.max())))
    if not len(depth):
        return Repeats(none, none, none, none)
    rank = np.empty(len(place), dtype=np.int64)
    rank[ordered(before, left)] = np.arange(len(place))
    size = last - first + 1
    node, at = np.repeat(np.arange(len(size)), size), ranges(first, size)
    inner = np.argsort(node * len(place) + rank[order[at]])
    node, at = node[inner], at[inner]
    own = order[at]
    # the second tree, of all nodes at once; a step too short for the repeat, or between nodes, parts it
    step = np.zeros(len(own), dtype=np.int64)
    same = common(before, left, own[:-1], own[1:])
    step[1:] = np.where((node[1:] == node[:-1]) & (same >= least - depth[node[1:]]), same + 1, 0)
    wide, first, last = intervals(step, 1)
    if not len(wide):
        return Repeats(none, none, none, none)
    size = last - first + 1
    every = at[ranges(first, size)]
    edge = np.cumsum(size) - size
    reach = common(after, right, order[np.minimum.reduceat(every, edge)], order[np.maximum.reduceat(every, edge)])
    keep = reach == depth[node[first]]  # else a child of the node holds them all, and tells more of them
    return Repeats(wide[keep] - 1, reach[keep], size[keep], own[ranges(first[keep], size[keep])])


def classes(buf: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, mix) -> np.ndarray:
    """A number for each place, the same for places with the same bytes on both sides. Places meet by a hash that
    ``mix`` makes and are compared by bytes; those of a hash with different bytes are ordered by these."""
    sides = [(size, side, k) for size, side in ((right, 1), (left, -1)) for k in range(-(-int(size.max(initial=0)) // 8))]
    key = mix((left << 8 | right).astype(np.uint64) + np.uint64(1))
    for size, side, k in sides:
        key = mix(key ^ word(buf, place, size, k, side))
    order = np.argsort(key, kind="stable")

    def alike(o: np.ndarray) -> np.ndarray:
        out = (left[o[1:]] == left[o[:-1]]) & (right[o[1:]] == right[o[:-1]])
        for size, side, k in sides:
            w = word(buf, place[o], size[o], k, side)
            out &= w[1:] == w[:-1]
        return out

    meet = key[order[1:]] == key[order[:-1]]
    same = alike(order)
    if (meet & ~same).any():
        group = np.cumsum(np.concatenate([[0], ~meet]))
        odd = np.flatnonzero(np.isin(group, group[1:][meet & ~same]))
        o = order[odd]
        order[odd] = o[np.lexsort([*(word(buf, place[o], size[o], k, side) for size, side, k in sides), left[o], right[o], group[odd]])]
        same = alike(order)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ~same])) if len(order) else 0
    return out
