import random

import corpus_pipeline
import numpy as np
import pytest

from quillon.llm import neardup as N


def slow_kept(rows):
    """Least doc_id of each class, all pairs being compared."""
    sets = {i: N.shingles(t) for i, t in rows}
    lab = {i: i for i in sets}
    alike = {i: [j for j in sets if N.similar(sets[i], sets[j])] for i in sets}
    while True:
        new = {i: min([lab[i], *(lab[j] for j in alike[i])]) for i in sets}
        if new == lab:
            return sorted(set(lab.values()))
        lab = new


def edited(rng, words, places):
    words = list(words)
    for k in rng.sample(range(len(words)), places):
        words[k] = f"edit{rng.randint(0, 10**9)}"
    return " ".join(words)


def test_similarity_at_the_bound():
    a, b = np.arange(9, dtype="<u8"), np.arange(1, 10, dtype="<u8")
    assert N.similar(a, b) and not N.similar(a, np.arange(2, 10, dtype="<u8"))
    assert len(N.shingles("a b c d e f")) == 2 and len(N.shingles("A b")) == 1 and not len(N.shingles(" \n"))


def test_sketches_lose_no_similar_pair(spark):
    rng = np.random.default_rng(4)
    rows, truth = [], []
    for n in (1, 9, 60, 64, 65, 128, 129, 250, 256, 257, 300, 1030):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        far = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for k in range(0, n // 5 + 1, max(1, n // 20)):
            for x, y in ((a, a[: n - k]), (a[: n - k], a), (a, far)):
                rows.append((len(rows), len(x), N.sketch(x).tolist(), len(y), N.sketch(y).tolist()))
                truth.append(bool(N.similar(x, y)))
    got = {r.i: r.likely for r in spark.createDataFrame(rows, "i int, n int, a array<long>, m int, z array<long>").selectExpr("i", N.may_be_similar("n", "a", "m", "z") + " as likely").collect()}
    assert all(got[i] for i, t in enumerate(truth) if t)
    assert sum(not got[i] for i, t in enumerate(truth) if not t) > 0.9 * truth.count(False) > 0


@pytest.mark.parametrize("sample", [1, 20_000])
def test_stage_drops_edited_copies(spark, docs_of, monkeypatch, sample):
    rng = random.Random(3)
    monkeypatch.setattr(N.classes, "__defaults__", (sample,))
    line = "all of this is here under the same terms as ever "
    texts = [None, "", " \n", "One", "one", line, line + "x"]
    for n in (6, 20, 50, 51, 120, 400):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
        texts += [line + " ".join(base), *(line * (k % 2) + edited(rng, base, min(n, 1 + k % 6)) for k in range(14))]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect())
    assert got == slow_kept(rows)
    assert len(got) < len(rows) - 20


def test_null_doc_ids(spark, docs_of):
    docs = docs_of([(None, "a b c"), (None, "a b c"), (3, "A b c"), (None, "z"), (None, "z"), (None, "Z"), (None, None)])
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.text or "").lower() for r in rows) == ["", "a b c", "z"]
    assert [r.doc_id for r in rows if r.doc_id is not None] == [3]


def test_empty(spark, docs_of):
    assert corpus_pipeline.near_dedup(spark, docs_of([]), "").count() == 0


def test_sets_are_those_of_five_words(spark):
    import pyarrow as pa

    class Sent:
        value = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))

    texts = ["a b c d e f g a b c d e", "one two", None, "a b c d e f g a b c d e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(range(4)), pa.array(texts)], names=["doc_id", "key", "text"])
    (got,) = N._sets(Sent)(iter([batch]))
    assert got.column("n").to_pylist() == [len(N.shingles(t)) for t in texts] == [7, 1, 0, 7]
    assert got.column("node")[0] == got.column("node")[3] and got.column("first")[3].as_py() is None
