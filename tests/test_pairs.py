"""All pairs of vectors, counted in cells of groups and in blocks."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import by_duckdb, by_spark

from quillon.functions import distances
from quillon.plans import scenarios


def _same(spark, folder, ids, vectors):
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}), folder / "embeddings.parquet")
    got = by_spark(scenarios.QUERIES["pair_distances"](spark, str(folder)))
    assert got == by_duckdb(scenarios.ORACLE["pair_distances"], str(folder))
    return got[1]


@pytest.mark.parametrize("scale", [0.1, 300, 1e5])
def test_pair_distances_in_groups(spark, tmp_path, monkeypatch, scale):
    monkeypatch.setattr(scenarios, "FEWEST", 100)
    vectors = np.random.default_rng(1).normal(0, scale, (700, 8)).astype(np.float32)
    assert _same(spark, tmp_path, list(range(700)), vectors.tolist())


def test_pair_distances_of_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scenarios, "FEWEST", 3)
    vectors = [None, [], [None, None], [1.0, 2.0], [1.0], [None, 2.5], [3.0, None, 4.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [0.0005, -0.0005, 9.0], None, [7.0]]
    assert _same(spark, tmp_path, [1, 2, 3, 4, 5, 6, 7, 8, 8, 9, None, None], vectors)


def test_pair_distances_of_few_rows(spark, tmp_path):
    assert _same(spark, tmp_path, [], []) == []
    assert _same(spark, tmp_path, [5], [[1.0]]) == []


def test_bounds_of_buckets():
    """Squares of whole buckets, and the number below, on both sides of single and double precision."""
    for k in (1, 4, 5, 100_000):
        for square in ((250 * k) ** 2 - 1, (250 * k) ** 2):
            told = distances.Counter()
            distances._count(np.array([square], np.float64), 250, told)
            assert dict(told) == {k - (square % 250 != 0): 1}


def test_pair_distances_makes_no_pairs_of_rows(spark):
    plan = scenarios.QUERIES["pair_distances"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
