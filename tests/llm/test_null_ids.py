"""Documents without a doc_id are rows like others in each stage."""

from quillon.llm import decontam as D
from quillon.llm import langid as L
from quillon.llm import simhash as S

LONG = " ".join(f"w{i}" for i in range(40))


def test_op8_and_its_dedup(docs_of):
    docs = docs_of([(None, "a b c"), (None, "A b c"), (5, "x y z"), (None, "x y z"), (None, LONG), (7, None)])
    got = {(r.doc_id, r.component_id) for r in S.simhash_components(docs).where("component_id is null or doc_id is null").collect()}
    assert got == {(None, None), (None, 5)}
    assert S.simhash_components(docs).count() == 6
    kept = sorted((r.doc_id or 0, (r.text or "").lower()) for r in S.simhash_dedup(docs).collect())
    assert kept == sorted([(0, "a b c"), (5, "x y z"), (0, LONG), (7, "")])


def test_language_filter_keeps_told_ones(docs_of, monkeypatch):
    monkeypatch.setattr(L, "predict", lambda docs, model: docs.selectExpr("doc_id", "if(text = '12', 'und', 'de') as lang_pred", "1d as score"))
    monkeypatch.setattr(L, "learned", lambda docs: None)
    got = L.language_filter(docs_of([(None, "ein haus"), (None, "12"), (1, "12"), (1, "eins"), (2, "zwei")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "ein haus"), (1, "eins"), (2, "zwei")]


def test_contaminated_ones_go_and_later_blocks_count(spark, docs_of):
    items = [" ".join(f"{p}{i}" for i in range(13)) for p in "ab"]
    bench = spark.createDataFrame([("1", items[0]), ("2", items[1])], "item_id string, text string")
    docs = docs_of([(None, f"{items[0]} {items[1]}"), (None, items[1]), (None, "clean"), (4, "clean too")])
    assert sorted(r.text for r in D.decontaminate(docs, bench).collect()) == ["clean", "clean too"]
    got = D.contamination(docs, bench, block_windows=5).collect()
    assert sorted((r.n_hit, r["items"]) for r in got) == [(0, []), (0, []), (13, ["2"]), (26, ["1", "2"])]
