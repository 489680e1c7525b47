"""The interval trees against all pairs of places."""

import random

import numpy as np

from quillon.llm import esa

LEAST = 6


def places(rng):
    raw, where = bytes(esa.PAD), []
    for _ in range(4):
        t = bytes(rng.choices(b"ab\0", k=rng.randint(0, 30)))
        where += [(len(raw) + i, min(4, i), min(9, len(t) - i)) for i in range(len(t) - 1) if t[i : i + 2] == b"ab"]
        raw += t
    return raw + bytes(esa.PAD), [np.array(x, dtype=np.int64) for x in zip(*where, strict=True)] if where else [np.zeros(0, np.int64)] * 3


def shared(raw, place, left, right):
    n = len(place)
    out = {}
    for i in range(n):
        for j in range(n):
            r = ell = 0
            while r < min(right[i], right[j]) and raw[place[i] + r] == raw[place[j] + r]:
                r += 1
            while ell < min(left[i], left[j]) and raw[place[i] - 1 - ell] == raw[place[j] - 1 - ell]:
                ell += 1
            out[i, j] = (ell, r)
    return out


def test_maximal_repeats_and_classes():
    rng = random.Random(1)
    for _ in range(150):
        raw, (place, left, right) = places(rng)
        n, buf = len(place), np.frombuffer(raw, np.uint8)
        pairs = shared(raw, place, left, right)
        want = set()
        for i in range(n):
            for j in range(i):
                ell, r = pairs[i, j]
                if ell + r >= LEAST:
                    own = tuple(k for k in range(n) if pairs[i, k][0] >= ell and pairs[i, k][1] >= r)
                    if (min(pairs[i, k][0] for k in own if k != i), min(pairs[i, k][1] for k in own if k != i)) == (ell, r):
                        want.add((ell, r, own))
        found = esa.maximal_repeats(buf, place, left, right, LEAST)
        ends = np.cumsum(found.count)
        got = [(int(a), int(z), tuple(sorted(found.members[e - c : e].tolist()))) for a, z, c, e in zip(found.left, found.right, found.count, ends, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
        cls = esa.classes(buf, place, left, right, lambda x: x & np.uint64(1))
        for (i, j), both in pairs.items():
            assert (cls[i] == cls[j]) == ((left[i], right[i]) == (left[j], right[j]) == both)
