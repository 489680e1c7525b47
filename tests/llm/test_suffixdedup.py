import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from quillon.llm import suffixdedup as S


def slow(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(8, 40)) for _ in range(6)]
    docs = [None, "", "short", "x" * 300, "x" * 120, "ab" * 200, "ab" * 60]
    for _ in range(150):
        parts = [text(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                p = p[rng.randint(0, 20) : -rng.randint(1, 20)]
            parts += [p, text(rng.randint(0, 12))]
        docs.append("".join(parts))
    docs += docs[20:40] + [passages[0]] * 20
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    rows = list(zip(ids, docs, strict=True))
    return [*rows, rows[30], (rows[31][0], rows[50][1])]


@pytest.mark.parametrize(("batch", "chunk"), [(3000, 4), (3000, 10**9), (10**8, 4)])
def test_against_brute_force(docs_of, batch, chunk):
    rows = corpus()
    got = S.removed_spans(docs_of(rows), batch_bytes=batch, chunk=chunk)
    assert sorted(tuple(r) for r in got.collect()) == slow(rows)


def test_cleaned_texts_keep_columns(docs_of):
    rows = [(1, "é" * 60 + "tail one"), (2, "head two " + "é" * 60), (3, None), (4, "y" * 49)]
    docs = docs_of(rows).selectExpr("*", "7 as batch", "'k' as bucket", "1 as deal", "2 as salts", "3 as rest", "4 as key", "5 as data")
    got = S.suffix_dedup(docs)
    assert got.columns == docs.columns
    out = {r.doc_id: (r.text, r.batch) for r in got.collect()}
    assert out == {1: (rows[0][1], 7), 2: ("head two ", 7), 3: (None, 7), 4: ("y" * 49, 7)}
    assert S.removed_spans(docs_of([])).count() == 0



def test_few_hashes_stay_exact(docs_of, monkeypatch):
    mix = S._mix
    monkeypatch.setattr(S, "_mix", lambda x: mix(x) & np.uint64(0xE000000000000003))
    rows = [(d, (t or "")[:400]) for d, t in corpus()[:120]]
    got = {}
    b = S.Batch(pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}))
    for d, s, z in zip(b.doc, b.starts, b.ends, strict=True):
        got.setdefault(int(d), []).append(int(b.covered()[s:z].sum()))
    want = {}
    for d, _, n, *_ in slow(rows):
        want.setdefault(d, []).append(n)
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}


def test_windows_that_several_chunks_leave():
    """What buckets of one dealt gram leave meets by its bytes, also where all hashes are alike."""
    texts = [b"p" * 60, b"p" * 60, b"q" * 60]
    rows = []
    for i, t in enumerate(texts):
        buf = np.frombuffer(t, np.uint8)
        w = np.lib.stride_tricks.sliding_window_view(buf, 50)
        n = len(w)
        data = S.squeezed(np.full(n, i), np.arange(n), np.full(n, i + 1, dtype=np.uint64) ^ np.uint64(1 << 63))
        rows.append((0, -1, data, zstandard.compress(w.tobytes())))
    out = S._last_answers(S._table([*rows, (0, 9, b"kept", None)], "key batch data text"))
    assert out.column("batch").to_pylist() == [9, 1]
    at, n = S.unsqueezed(out.column("data")[1].as_py())
    assert len(at) == 11 and n.tolist() == [1] * 11
