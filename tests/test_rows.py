"""Sources and row-wise operators on closed-form integers."""

import asyncio

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.dataset import Dataset
from quillon.operators import actions, transforms
from quillon.sources import files, generate


def ints(df, c="v"):
    return sorted(r[c] for r in df.select(c).collect())


@pytest.fixture
def base(spark):
    """0..63, one row a partition."""
    return Dataset(generate.source_i(spark, 64, lambda i: [i], "v int"))


def test_choose_filter_collect(base):
    assert ints(base.choose(v="case when v % 2 = 0 then v * v end").df) == [i * i for i in range(0, 64, 2)]
    assert ints(base.filter("v % 4 = 0").df) == list(range(0, 64, 4))
    assert ints(base.flat_map("array(v + 64, v + 128)", "v").df) == list(range(64, 192))
    assert base.num_partitions == 64


def test_flat_map_leaves_out_null_and_empty(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k int, a array<int>")
    assert ints(transforms.flat_map(df, "a", "v", "k")) == [1, 2]


def test_mapi_counts_from_zero_in_each_partition(spark):
    df = generate.source_i(spark, 7, lambda p: ((p, j) for j in range(11)), "i int, j int")
    got = Dataset(df).mapi(i="i", j="j").df.collect()
    assert len(got) == 77 and all(r.part == r.i and r.idx == r.j for r in got)


@pytest.mark.parametrize("rows", [1, 2, 3, 8, 15, 16, 17, 0])
def test_batches_are_cut_anew(spark, rows):
    df = generate.source_i(spark, 5, lambda p: range(p * 16, p * 16 + 16), "v int")
    sizes = transforms.map_batches(df, lambda t: pa.table({"n": pa.array([t.num_rows], pa.int64())}), "n long", rows=rows)
    want = [16] if rows == 0 or rows >= 16 else [rows] * (16 // rows) + ([16 % rows] if 16 % rows else [])
    assert ints(sizes, "n") == sorted(want * 5)
    assert ints(Dataset(df).rows_reorg(rows).df) == list(range(80))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 99, 100])
def test_distribute(spark, n):
    assert ints(generate.distribute(spark, list(range(1, n + 1)), "v int")) == list(range(1, n + 1))
    for parts in (1, 3, 10):
        assert ints(generate.distribute_n(spark, list(range(n)), "v int", parts)) == list(range(n))
        assert ints(generate.distribute_uneven_n(spark, list(range(n)), "v int", parts)) == list(range(n))


def test_distribute_cuts(spark):
    def sizes(df):
        return df.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").rdd.map(lambda r: r["count"]).collect()

    assert sizes(generate.distribute_n(spark, list(range(10)), "v int", 4)) == [3, 3, 3, 1]
    assert sizes(generate.distribute_uneven_n(spark, list(range(10)), "v int", 4)) == [2, 2, 2, 4]


def test_init(spark):
    assert generate.init_s(spark, 3, 5).count() == 15
    assert generate.init_n(spark, 0, 7).count() == 0
    assert generate.init(spark, "p", 4).groupBy("p").count().count() == 3


def test_async_and_parallel_policies(base):
    async def bad(r):
        if r["v"] == 5:
            raise ValueError("five")
        if r["v"] == 6:
            await asyncio.sleep(30)
        return {"v": r["v"]}

    got = transforms.async_map(base.df, bad, "v int", timeout=0.5, on_error="drop")
    assert ints(got) == [i for i in range(64) if i not in (5, 6)]
    with pytest.raises(Exception, match="five"):
        transforms.async_map(base.df, bad, "v int", timeout=0.5).collect()
    assert ints(base.parallel_mapi(lambda r: {"v": r["v"] + r["idx"]}, "v int").df) == list(range(64))
    with pytest.raises(ValueError, match="on_error"):
        base.parallel_map(lambda r: r, "v int", on_error="retry")


def test_expressions_reach_the_scan(spark):
    plan = Dataset(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")).filter("l_quantity > 45").map(k="l_orderkey").df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "in" / "sub" / "b.txt").write_text("x")
    whole = files.folder(spark, str(tmp_path / "in"), "*.txt")
    assert {r.path: bytes(r.content) for r in whole.collect()} == {"a.txt": b"one\ntwo\n", "sub/b.txt": b"x"}
    files.retrieve_folder(whole, str(tmp_path / "out"))
    assert (tmp_path / "out" / "sub" / "b.txt").read_bytes() == b"x"
    got = files.lines(spark, str(tmp_path / "in" / "a.txt"), totals=True).collect()
    assert sorted((r.line, r.content or "") for r in got) == [(1, "one"), (2, ""), (2, "two")]
    (tmp_path / "svm").write_text("1 3:0.5 7:2\n\n-1\n")
    assert sorted((r.label, r.indices, r.vals) for r in files.sparse_examples(spark, str(tmp_path / "svm")).collect()) == [(-1.0, [], []), (1.0, [3, 7], [0.5, 2.0])]


def test_retrieve_stays_in_the_folder(spark, tmp_path):
    bad = spark.createDataFrame([("../x", b"1")], "path string, content binary")
    with pytest.raises(Exception, match="leads out"):
        files.retrieve_folder(bad, str(tmp_path / "out"))


def test_actions(spark, base, capsys):
    seen = []
    base.local_iter(lambda r: seen.append(r.v))
    assert sorted(seen) == list(range(64))
    base.printfn("v={}", 2)
    assert capsys.readouterr().out.count("v=") == 2
    assert actions.run_on_one(spark, lambda: 7) == 7
    actions.execute(spark, lambda: None, 3)
