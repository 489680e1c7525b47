"""Words by label and documents' scores on odd tables, with all words frequent, some, or none; and what is sent."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import by_duckdb, by_spark

from quillon.plans import pipelines, scenarios

DOCUMENTS = [(1, "a b c"), (2, "a  b b"), (2, "b d"), (3, None), (4, ""), (5, "a e f"), (None, "a b"), (None, "b g"), (6, "z only here"), (7, "c f f"), (8, "q")]
LABELS = [(1, 1), (1, 1), (2, 0), (2, 1), (3, 1), (5, 0), (7, 0), (7, None), (8, 2), (99, 1), (None, 1)]


def _tables(folder, labels):
    doc_ids, texts = zip(*DOCUMENTS, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "text": pa.array(texts)}), folder / "documents.parquet")
    ids, quality = zip(*labels, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(quality, pa.int32())}), folder / "labels.parquet")
    return str(folder)


@pytest.mark.parametrize("common", [0, 3, 300_000])
@pytest.mark.parametrize("labels", [LABELS, [x for x in LABELS if x[1] != 0]])
def test_scores_of_odd_documents(spark, tmp_path, monkeypatch, labels, common):
    monkeypatch.setattr(scenarios, "COMMON", common, raising=False)
    d = _tables(tmp_path, labels)
    got = by_spark(scenarios.QUERIES["naive_bayes_scores"](spark, d))
    assert got == by_duckdb(scenarios.ORACLE["naive_bayes_scores"], d)
    assert got[1]


def test_counts_of_odd_documents(spark, tmp_path):
    d = _tables(tmp_path, LABELS)
    assert by_spark(pipelines.QUERIES["naive_bayes_counts"](spark, d)) == by_duckdb(pipelines.ORACLE["naive_bayes_counts"], d)


@pytest.mark.parametrize("query", [scenarios.QUERIES["naive_bayes_scores"], pipelines.QUERIES["naive_bayes_counts"]])
def test_pairs_of_document_and_word_are_not_made_distinct(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "doc_id" in x.split("]")[0] and "word" in x.split("]")[0]]
    assert "distinct doc_id" not in plan
