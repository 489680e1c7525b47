import itertools
import math

import numpy as np
import pytest

from quillon.llm import langid as L

SF = "/root/testdata/sf0.001"


def test_forward_sums_all_segmentations():
    vocab = {p: i + 1 for i, p in enumerate(["▁a", "▁", "a", "b", "ab", "▁ab", "ba", "bab"])}
    rng = np.random.default_rng(0)
    probs = rng.random((len(vocab) + 1, 2)) / 9
    for w in ["▁abab", "▁a", "▁abbax", "▁babab"]:
        want = np.zeros(2)
        counts = np.zeros(len(probs))
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts, last = [], 0
            for i, c in enumerate([*cuts, 1]):
                if c:
                    parts.append(w[last : i + 1])
                    last = i + 1
            ids = [vocab.get(p, 0 if len(p) == 1 else None) for p in parts]
            if None not in ids:
                p = np.prod(probs[ids], axis=0)
                want += p
                for i in ids:
                    counts[i] += p[0]
        got = L.likelihoods([w], vocab, probs)[0]
        assert np.allclose(got, np.log(want))
        assert np.allclose(L.expected_counts([w], np.array([3.0]), vocab, probs[:, :1]), 3 * counts / want[0])


def slow(word, vocab, probs, longest):
    """Log sums over all segmentations, each step with its own logarithms."""
    out = []
    for x in range(probs.shape[1]):
        a = [0.0]
        for j in range(1, len(word) + 1):
            steps = []
            for k in range(1, min(longest, j) + 1):
                i = vocab.get(word[j - k : j], 0 if k == 1 else None)
                if i is not None:
                    steps.append(a[j - k] + math.log(probs[i, x]))
            top = max(steps)
            a.append(top + math.log(sum(math.exp(s - top) for s in steps)))
        out.append(a[-1])
    return out


def test_words_of_any_length(monkeypatch):
    vocab = L.vocabulary()
    assert "▁government" in vocab and vocab.longest > 10
    rng = np.random.default_rng(1)
    probs = rng.random((len(vocab) + 1, 2)) / 1e4
    words = ["▁donaudampfschifffahrtsgesellschaftskapitän" + "swissenschaftlich" * 2, "▁government" * 90, "▁" + "中文" * 400, "▁a"]
    got = L.likelihoods(words, vocab, probs)
    want = [slow(w, vocab, probs, vocab.longest) for w in words]
    assert np.allclose(got, want) and (got[1] < -800).all()
    monkeypatch.setattr(L, "SEGMENT", 100)
    assert np.allclose(L.likelihoods(words, vocab, probs), want)
    monkeypatch.undo()
    one = L.expected_counts(["▁government" * 90], np.array([2.0]), vocab, probs[:, :1])
    sizes = np.zeros(len(probs))
    for p, i in vocab.items():
        sizes[i] = len(p)
    assert np.isclose((one * np.where(sizes == 0, 1, sizes)).sum(), 2 * 90 * len("▁government"))


def test_held_out_accuracy_and_edges(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.learned(docs)
    got = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(L.held_out()).collect()
    assert got and np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    odd = docs_of([None, "", "12 !! 34", "word", "x" * 50_000, "the and of " * 20_000, "中文 日本", "½ ² ① Ⅷ"])
    rows = {r.doc_id: r for r in L.predict(odd.selectExpr("*", "1 as score"), model).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 7)] == ["und"] * 4 and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows.values())
    assert rows[3].lang_pred != "und" and rows[5].score > 0.99
    assert L.language_filter(docs).count() == docs.count()
    none = L.learned(docs_of([]))
    assert L.predict(odd, none).where("lang_pred = 'und' and score = 0").count() == 8
    assert L.predict(docs_of([]), model).count() == 0


@pytest.mark.parametrize("word", ["Don't", "a1b", "ÉTÉ", "_", "-"])
def test_parts(word):
    assert all(p.startswith("▁") for p in L.parts_of(word.lower()))
    assert L.parts_of("a½b²c") == ["▁a", "▁b", "▁c"]


def test_rows_are_told_each(docs_of, monkeypatch):
    """Repeated rows, null ids and extra columns; the query against sums over all segmentations."""
    vocab = L.vocabulary()
    probs = np.random.default_rng(2).random((len(vocab) + 1, 2)) / 1e3
    texts = [(1, "Das Haus, das alte"), (1, "Das Haus, das alte"), (1, "the old house"), (None, "the old house"), (None, None), (4, "x1y2")]
    docs = docs_of(texts).selectExpr("*", "1 as score", "'q' as lang_pred")
    got = sorted(((r.doc_id or 0, r.lang_pred, round(r.score, 9)) for r in L.predict(docs, (["de", "en"], probs)).collect()))
    want = []
    for d, t in texts:
        parts = [p for w in (t or "").lower().split() for p in L.parts_of(w)]
        ll = np.sum([slow(p, vocab, probs, vocab.longest) for p in parts], axis=0) if parts else None
        want.append((d or 0, "und", 0.0) if ll is None else (d or 0, ["de", "en"][int(ll.argmax())], round(float(1 / np.exp(ll - ll.max()).sum()), 9)))
    assert got == sorted(want)
