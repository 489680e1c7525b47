import random
import zlib
from collections import Counter, defaultdict

from quillon.llm import kdshard as K


def test_shares_and_slots(docs_of):
    texts = [None, "", *["hot text é " * 40] * 700, *[f"word{i} " * (1 + i * i % 97) for i in range(1400)]]
    rows = [*enumerate(texts), (5, texts[5])]
    got = K.kd_shards(docs_of(rows).selectExpr("*", "1 as shard", "2 as node", "3 as content")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 24
    assert max(abs(x - mean) for x in sizes.values()) <= 2 * max(r.size for r in got)


def test_small_tables(docs_of):
    assert K.kd_shards(docs_of([])).count() == 0
    assert [r.slot for r in K.kd_shards(docs_of(["one"])).collect()] == [0]
    assert K.kd_shards(docs_of(["same"] * 30)).count() == 30
    odd = docs_of([(None, "a"), (None, "a"), (None, None), (3, "b"), (3, "c")])
    got = K.kd_shards(odd, 3).collect()
    assert len(got) == 5 and all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(3))


def tree(rows, shards, spread, first=0):
    """{row: shard} by sorting; rows: (index, size, coordinates)."""
    if shards == 1 or not rows:
        return {r[0]: first for r in rows}
    lo, hi = ({d: f(r[2][d] for r in rows) for d in K.DIMS} for f in (min, max))
    width = {d: ((hi[d] >> K.LOW) - (lo[d] >> K.LOW)) / max(1, spread[d]) for d in K.DIMS}
    dim = max(K.DIMS, key=lambda d: (width[d], -K.DIMS.index(d)))
    if lo[dim] == hi[dim]:
        left, right = [], rows
    else:
        weight = Counter()
        for r in rows:
            weight[r[2][dim]] += r[1]
        want = sum(weight.values()) * (shards // 2) / shards
        for at in sorted(weight):
            if weight[at] > want:
                break
            want -= weight[at]
        split = at + 1 if 2 * want > weight[at] else at
        left, right = ([r for r in rows if (r[2][dim] < split) == side] for side in (True, False))
    return tree(left, shards // 2, spread, first) | tree(right, shards - shards // 2, spread, first + shards // 2)


def test_against_a_tree_by_sorting(spark):
    """All nodes of the tree, with ties, hot values and nulls, against sorted rows."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        text = None if i % 90 == 0 else "".join(rng.choices(["word ", "12 ", "\n", "é"], weights=[9, rng.randint(0, 3), 1, 1], k=rng.randint(0, 60)))
        rows.append((i if i % 7 else i // 7, text, rng.choice(["de", "en", "en", None]), rng.choice(["hot", "hot", "web", "zine", None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = [(k, r.size, {d: r[d] for d in K.DIMS}, (r.doc_id, r.text_crc32)) for k, r in enumerate(K.measured(docs).collect())]
    spread = {d: (max(r[2][d] for r in measured) >> K.LOW) - (min(r[2][d] for r in measured) >> K.LOW) for d in K.DIMS}
    for shards in (24, 7, 1):
        want = Counter((measured[k][3], s) for k, s in tree(measured, shards, spread).items())
        got = K.kd_shards(docs, shards).collect()
        assert Counter(((r.doc_id, r.text_crc32), r.shard) for r in got) == want
