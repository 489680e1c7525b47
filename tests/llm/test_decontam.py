import hashlib
import random
import re

from quillon.llm import decontam as D


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def slow(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, got = set(), set()
        for g, ids in wins.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    got |= ids
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def longest(docs, items):
    """The longest stretch of hit words of each document, in the order of slow()."""
    out = []
    for i, t in docs:
        w, hit = words(t), set()
        for _, x in items:
            g = words(x)
            for k in range(max(1, len(g) - 12) if g else 0):
                own = g[k : k + 13]
                for j in range(len(w) - len(own) + 1):
                    if w[j : j + len(own)] == own:
                        hit.update(range(j, j + len(own)))
        best = run = 0
        for j in range(len(w)):
            run = run + 1 if j in hit else 0
            best = max(best, run)
        out.append((i, len(w), len(hit), best))
    order = sorted(range(len(docs)), key=lambda k: str(slow_row(docs[k], items)))
    return [out[k][3] for k in order]


def slow_row(doc, items):
    return slow([doc], items)[0]


def cases():
    rng = random.Random(6)
    vocab = ["a", "The", "été", "x1", "ab", "中", "thing", "of"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([13, 14, 20, 30])))) for i in range(12)]
    items += [(12, "rare"), (13, "two words"), (14, ""), (15, None), (16, "!!"), (17, items[0][1])]
    docs = [None, "", "...", "RARE", "rare-rare", "rarely", "two  words!", "twowords"]
    for _ in range(120):
        t = " ".join(rng.choices(vocab, k=rng.randint(0, 60)))
        if rng.random() < 0.6:
            t += ", " + rng.choice(items)[1].__str__().upper().replace("É", "é") + " - " + " ".join(rng.choices(vocab, k=rng.randint(0, 30)))
        docs.append(t)
    return [*enumerate(docs), (9, docs[9]), (500, "a b " * 9000 + items[1][1])], items


def test_against_brute_force(docs_of, spark):
    docs, items = cases()
    b = spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    more = docs_of(docs).selectExpr("*", "1 as key", "'x' as items", "2 as item_id")
    got = D.verdicts(more, b)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    blocks = D.contamination(docs_of(docs), b, block_windows=40)
    assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in blocks.collect()) == sorted(w[:4] for w in want)
    kept = D.decontaminate(more, b)
    assert kept.columns == more.columns
    assert {r.doc_id for r in kept.collect()} == {w[0] for w, long in zip(want, longest(docs, items), strict=True) if not w[5] and long < 13}


def test_empty_tables(docs_of, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.verdicts(docs_of([]), none).count() == 0
    assert [r.n_hit for r in D.verdicts(docs_of(["a b"]), none).collect()] == [0]


def test_rows_of_one_id_have_verdicts_of_their_own(docs_of, spark):
    item = " ".join(f"w{i}" for i in range(20))
    b = spark.createDataFrame([(1, item), (1, item), (2, "rare")], "item_id long, text string")
    rows = [(1, "clean"), (1, item), (1, "x " * 2000 + item), (2, "rare " + "x " * 30), (2, "rare x"), (None, item), (None, "clean")]
    assert sorted((r.doc_id or 0, len(r.text)) for r in D.decontaminate(docs_of(rows), b).collect()) == [(0, 5), (1, 5), (2, 65)]
    got = D.verdicts(docs_of([(1, item), (1, item)]), b).collect()
    assert [(r.n_hit, r.n_items, r.items_sha256) for r in got] == [(20, 1, hashlib.sha256(b"1").hexdigest())] * 2


def test_large_benchmark():
    """Some 60 bytes of memory for each window, and the same hits as those of a small block."""
    import tracemalloc

    rng = random.Random(9)
    texts = [b" " + b" ".join(b"%d" % rng.randint(0, 10**6) for _ in range(200)) + b" " for _ in range(400)]
    tracemalloc.start()
    m = D.Matcher([str(i) for i in range(len(texts))], texts)
    windows = len(m.pattern)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert windows == 400 * 188 and held < windows * 100 + (40 << 20)
    doc = b" ".join(texts[7].split()[50:80]).decode()
    assert m.search(["a " + doc, doc[:40], None]) == [(31, [(1, 31)], {"7"}), (len(doc[:40].split()), [], set()), (0, [], set())]
