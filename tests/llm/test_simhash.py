import random

import numpy as np
import xxhash

from quillon.llm import simhash as S


def slow(text):
    words = [w for w in (text or "").encode().translate(S.LOWER).split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fp = {i: slow(t) for i, t in rows}
    lab = {i: i for i in fp}
    while True:
        new = {i: min(lab[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2) for i in fp}
        if new == lab:
            return fp, lab
        lab = new


def test_golay_keys_meet_within_two_bits():
    rng = random.Random(1)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.choice([0, 1, 2])):
            b ^= 1 << k
        r, k = S.golay_keys(np.array([a, b], dtype=np.uint64))
        assert set(k[r == 0]) & set(k[r == 1])


def test_against_brute_force(docs_of, spark):
    rng = random.Random(2)
    vocab = ["the", "Cat", "ein", "été", "x", "haus"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(0, 6))) for _ in range(60)]
    long = " ".join(f"w{rng.randint(0, 999)}" for _ in range(3000))
    near = [long + f" tail{i}" for i in range(25)]
    rows = list(enumerate([None, "", " \t\n", "One", "one", *base, long, long, *near]))
    rng.shuffle(rows)
    fp, lab = slow_components(rows)
    for hot in (2, 256):
        distinct = S.fingerprints(docs_of(rows)).groupBy("fp").agg({"doc_id": "min"}).toDF("fp", "rep")
        assert S.links(distinct, hot_key=hot).count() >= 1
        S.HOT_KEY = hot
        got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in S.simhash_components(docs_of(rows)).collect()}
        assert got == {i: (fp[i], lab[i]) for i, _ in rows}
    S.HOT_KEY = 256


def test_empty_and_extra_columns(spark, docs_of):
    assert S.simhash_components(docs_of([])).count() == 0
    more = docs_of(["a b c", "a b c", "z"]).selectExpr("*", "1 as fp", "2 as component_id", "3 as _keep")
    kept = S.simhash_dedup(more)
    assert kept.columns == more.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
