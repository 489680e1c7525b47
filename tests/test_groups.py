"""Folds, joins, zips, sorts and layouts on closed-form integers."""

import pytest
from pyspark.sql import functions as F

from quillon.dataset import Dataset
from quillon.operators import aggregates, combine, joins, layout, position, sorting
from quillon.sources import generate


def test_fold_and_reduce(spark):
    df = generate.source_i(spark, 127, lambda i: [i], "v int")
    assert aggregates.fold_python(df, lambda s, r: s + r["v"], lambda a, b: a + b, 0) == 8001
    squares = generate.source_i(spark, 37, lambda i: [i * i], "v int")
    assert aggregates.reduce_rows(squares, "v", agg="sum(v)") == 16206
    assert aggregates.reduce_rows(squares, "v", merge=lambda a, b: a + b) == 16206


def test_reduce_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "CHUNK", 3)
    df = spark.range(0, 100, 1, 4).withColumn("id", F.when(F.col("id") != 7, F.col("id")))
    assert aggregates.reduce_rows(df, "id", merge=lambda a, b: a + b) == 4950 - 7


def test_reduce_of_nothing_raises(spark):
    for how in ({"agg": "sum(id)"}, {"merge": lambda a, b: a + b}):
        with pytest.raises(ValueError, match="empty"):
            aggregates.reduce_rows(spark.range(0), "id", **how)


def test_seeds(spark):
    df = generate.source_i(spark, 5, lambda i: [i] if i < 3 else [], "v int")
    assert aggregates.fold_python(df, lambda s, r: s + r["v"], lambda a, b: a + b, 10, "per_partition") == 53
    assert aggregates.fold_python(spark.range(0), lambda s, r: s, lambda a, b: a, "seed") == "seed"
    with pytest.raises(ValueError):
        aggregates.fold_python(df, None, None, 0, "twice")


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_map_reduce(spark, n):
    df = generate.source_i(spark, 64, lambda i: [i], "v int")
    pairs = F.array(*[F.struct(F.floor(F.col("v") / 2).cast("int").alias("k"), (F.col("v") * k).alias("v")) for k in range(1, n + 1)])
    got = {r.k: sorted(r.v) for r in aggregates.map_reduce(df, pairs).collect()}
    assert got == {k: sorted(v * m for v in (2 * k, 2 * k + 1) for m in range(1, n + 1)) for k in range(32)}


def test_null_keys_are_one_group_and_do_not_join(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, v int")
    assert {r.k: r["values"] for r in aggregates.group_by_key(df, ["k"], "v").collect()} == {None: [1, 2], 1: [3]}
    assert joins.inner_join(df, df.withColumnRenamed("v", "w"), ["k"]).count() == 1


@pytest.mark.parametrize("sizes", [(4, 8, 4, 4), (7, 3, 5, 9), (1, 16, 1, 0), (3, 1, 0, 3)])
def test_joins_agree_with_dictionaries(spark, sizes):
    bins, size, a_bins, b_bins = sizes
    a = {k: k * 10 for k in range(min(bins, a_bins) * size)}
    b = {k: str(k) for k in range(size, size + b_bins * size)}
    left = spark.createDataFrame(list(a.items()), "k int, a long")
    right = spark.createDataFrame(list(b.items()), "k int, b string")

    def got(f):
        return sorted(tuple(r) for r in f(left, right, ["k"]).select("k", "a", "b").collect())

    assert got(joins.inner_join) == [(k, a[k], b[k]) for k in sorted(a.keys() & b.keys())]
    assert got(joins.left_outer_join) == [(k, a[k], b.get(k)) for k in sorted(a)]
    assert {r[0]: r[1:] for r in got(joins.right_outer_join)} == {k: (a.get(k), b[k]) for k in b} if b else True
    with pytest.raises(ValueError):
        joins.merge_join(left, right, ["k"], "full")


def test_duplicate_keys_multiply_or_zip(spark):
    a = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "k int, a int")
    b = spark.createDataFrame([(1, 20), (1, 21)], "k int, b int")
    assert joins.inner_join(a, b, ["k"]).count() == 6
    got = joins.left_outer_join(a, b, ["k"], one_to_one=True, order_a=["a"], order_b=["b"])
    assert sorted((r.a, r.b) for r in got.collect()) == [(10, 20), (11, 21), (12, None)]


def test_cross_joins(spark):
    x, y = spark.range(64).selectExpr("id as a"), spark.range(8).selectExpr("id as b")
    assert joins.cross_join(x, y).count() == 512
    odd = joins.cross_join_choose(x, y, "(a + b) % 2 = 1", s="a + b")
    assert odd.count() == 256 and odd.where("s % 2 = 0").isEmpty()
    folded = joins.cross_join_fold(x, y, ["a"], {"s": "sum(a + b)"})
    assert all(r.s == 8 * r.a + 28 for r in folded.collect())
    with pytest.raises(ValueError, match="bytes"):
        joins.cross_join_fold_array(x, y, "0L", lambda s, b: s, "s", limit_bytes=30)
    named = spark.createDataFrame([(1, 2, 3)], "k int, _nth int, _all int")
    assert joins.inner_join(named, named.toDF("k", "other", "third"), ["k"]).columns == ["k", "_nth", "_all", "other", "third"]
    assert joins.merge_join(named, named.select("k", "_all").toDF("k", "w"), ["k"], one_to_one=True).first()["_nth"] == 2
    assert joins.cross_join_fold_array(named, y, "0L", lambda s, b: s + b["b"], "s").first()["_all"] == 3


def test_multicast_checks_size(spark):
    df = spark.range(1000)
    assert "broadcast" in layout.multicast(df)._jdf.queryExecution().logical().toString().lower() or layout.estimated_bytes(df) <= layout.BROADCAST_BYTES
    assert layout.multicast(df, limit=10) is df


@pytest.mark.parametrize("n", [8, 17, 23])
def test_zip_map_mix(spark, n):
    sides = [spark.range(0, n, 1, 4).selectExpr(f"id as k{i}", f"id * {i + 1} as v{i}") for i in range(4)]
    orders = [[f"k{i}"] for i in range(4)]
    got = combine.zip_rows(sides, orders, k="k0", s="v0 + v1 + v2 + v3").collect()
    assert sorted((r.k, r.s) for r in got) == [(k, 10 * k) for k in range(n)]
    by_place = combine.zip_rows([s.select(f"v{i}") for i, s in enumerate(sides[:3])], s="v0 + v1 + v2").collect()
    assert sorted(r.s for r in by_place) == [6 * k for k in range(n)]


def test_zip_of_unequal_sides_raises(spark):
    with pytest.raises(ValueError, match="differ"):
        combine.zip_rows([spark.range(3).toDF("a"), spark.range(4).toDF("b")], [["a"], ["b"]])


def test_split_and_merge(spark):
    df = spark.range(0, 256, 1, 16).selectExpr("id as k", "id * id as s")
    a, b = combine.split(df, {"k": "k"}, {"s": "s"})
    assert all(r.s == r.k**2 for r in combine.rejoin([a, b]).collect())
    assert combine.merge(df, df, df).count() == 768


def test_positions_over_the_whole(spark):
    df = spark.createDataFrame([(i * 7 % 31,) for i in range(31)], "v int")
    assert sorted((r.v, r["_index"]) for r in position.overall(df, "v").collect()) == [(i, i) for i in range(31)]
    assert position.overall(df.limit(0), "v").count() == 0


def test_bin_sort(spark):
    df = generate.source_i(spark, 4, lambda i: (i * 16 + j for j in range(16)), "v int")
    got = sorting.bin_sort(df, 4, "v - 100", ["v"]).select("v", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")).collect()
    bins = {}
    for r in sorted(got, key=lambda r: r.i):
        bins.setdefault(r.p, []).append(r.v)
    assert all(v == sorted(v) and len({x % 4 for x in v}) == 1 for v in bins.values()) and sum(map(len, bins.values())) == 64


def test_bin_sort_unique_is_settled_by_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, sorting.bin_sort_by_key(df, 3, "k", unique=True).collect())) == [(1, "a"), (2, "c")]


def test_unique_key_partitions(spark):
    df = spark.createDataFrame([(k % 5, k) for k in range(40)] + [(None, -1)], "k int, v int")
    placed = layout.repartition_by_unique_key(df, "k")
    assert placed.count() == 41
    assert placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct(F.coalesce("k", F.lit(-1))).alias("n")).where("n <> 1").isEmpty()
    many = layout.repartition_by_unique_key(df, "v", most=3)  # keys share partitions, each being in one
    assert many.count() == 41 and many.rdd.getNumPartitions() == 3
    assert {r.p: r.n for r in many.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 14, 1: 14, 2: 13}


def test_cache_stops_recomputation(spark):
    made = spark.sparkContext.accumulator(0)

    def gen(i):
        made.add(1)
        return [i]

    kept = Dataset(generate.source_i(spark, 4, gen, "v int")).cache_in_memory()
    assert kept.count() == 4 and kept.count() == 4 and made.value == 4
    kept.df.unpersist()


def test_take_stops_early(spark):
    df = generate.source_i(spark, 4, lambda i: ([1] * 100001), "v int")
    assert [len(sorting.take(df, n)) for n in (10, 100)] == [10, 100]


def test_reducer_of_ones_own_by_key(spark):
    rows = [(k % 3, k) for k in range(20_000)] + [(7, None), (None, 5)]
    df = spark.createDataFrame(rows, "k int, v long")
    got = {r.k: r.value for r in aggregates.reduce_by_key_with(df, ["k"], "v", lambda a, b: F.greatest(a, b)).collect()}
    assert got == {0: 19998, 1: 19999, 2: 19997, None: 5}


def test_helpers(spark):
    from quillon.functions import scalar

    assert scalar.filled(10, [1, 20, 4]) == [1, 5, 4] and scalar.filled(3, []) == []
    df = spark.sql("select timestamp'2024-05-06 07:08:09.123456' as t, 'secret' as s")
    got = df.select(scalar.version_time(scalar.version_text("t")).alias("t"), F.col("t").alias("u"), scalar.decrypted(scalar.encrypted("s", "'0123456789abcdef'"), "'0123456789abcdef'").alias("s"), scalar.sha512("s").alias("h")).first()
    assert got.t == got.u and got.s == "secret" and len(got.h) == 128


def test_calls_and_streams(spark):
    import asyncio

    from quillon.functions import registry

    registry.register_plan("up to", lambda s, n: s.range(n))
    rows = registry.stream_plan(spark, "up to", 5)
    assert next(rows).id == 0 and [r.id for r in rows] == [1, 2, 3, 4]
    registry.register_call("twice", lambda x: 2 * x)

    async def both():
        return await asyncio.gather(*(registry.call_async(spark, "twice", k) for k in (1, 2)))

    assert asyncio.run(both()) == [2, 4]


def test_shared_folder_is_named_on_a_cluster(monkeypatch, tmp_path):
    from quillon import runtime

    class Session:
        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1000]"

            class conf:  # noqa: N801
                get = staticmethod(lambda key, other: other)

            getConf = staticmethod(lambda: Session.sparkContext.conf)  # noqa: N815
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session)


def test_lines_in_splits(spark, tmp_path):
    from quillon.sources import files

    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "b.log").write_text("x\r\ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.lines(spark, str(tmp_path), totals=True)
        rows = sorted((r.file, r.line, r.content) for r in got.where("content is not null").collect())
        assert got.rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == sorted([("a.log", i + 1, f"line {i}") for i in range(5000)] + [("b.log", 1, "x"), ("b.log", 2, "y")])
    assert sorted((r.file, r.line) for r in got.where("content is null").collect()) == [("a.log", 5000), ("b.log", 2)]
