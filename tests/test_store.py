"""Stored sets, the key-value store, named functions and streams."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import registry
from quillon.functions.scalar import scan, stable_id, unit_hash, version_text
from quillon.sources.store import KVStore, Store
from quillon.streaming import events


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "root"))


def test_round_trip_and_versions(store, spark):
    rows = [(i, i * i) for i in range(1, 17)]
    for parts in (1, 4, 7):
        store.store(rows, "k int, v int", f"set_{parts}", partitions=parts)
        assert sorted(map(tuple, store.load(f"set_{parts}").collect())) == rows
    store.save(spark.range(3), "set_1", version=2**62)
    assert store.length("set_1") == 3 and store.size_in_bytes("set_1") > 0
    assert [n for n, _ in store.try_find("set_*")] == ["set_1", "set_4", "set_7"]
    with pytest.raises(FileNotFoundError):
        store.load("none")
    assert store.store(rows, "k int, v int", "gone", cancelled=lambda: True) is None
    assert store.try_find("gone") == []


def test_lazy_and_monitored_saves(store, spark):
    df = store.lazy_save(spark.range(10).toDF("v"), "later")
    assert store.try_find("later") == []
    assert store.run(df.count) == 10 and store.length("later") == 10
    assert sorted(r.v for r in store.save_with_monitor(df, "seen", "v > 7")) == [8, 9]


def test_key_value_store(store):
    kv = KVStore(store, "kv", "int", default=0, ignore_case=True)
    assert kv.get("a") == 0
    kv.put(("A", 5), ("b", 1))
    kv.update(("a", 2))
    kv.update(("a", 3))
    assert kv.get("A") == 10 and kv.get("B") == 1
    kv.put(("a", 1))
    assert kv.get("a") == 1
    kv.clear()
    assert kv.get("a") == 0


def test_named_functions(spark):
    registry.register_scalar(spark, "plus_one", lambda s: s + 1, "long")
    assert spark.sql("select plus_one(id) as v from range(3)").agg(F.sum("v")).first()[0] == 6
    registry.register_plan("upto", lambda s, n: s.range(n))
    assert registry.import_plan(spark, "upto", 4).count() == 4
    registry.register_call("double", lambda x: 2 * x)
    assert registry.call(spark, "double", 21) == 42


def test_functions(spark):
    row = spark.sql("select 'ab12' as t, timestamp'2020-01-02 03:04:05' as ts").select(stable_id("t").alias("id"), scan("t", "([a-z]+)([0-9]+)", 1, 2).alias("g"), version_text("ts").alias("v"), unit_hash("t").alias("u")).first()
    assert len(row.id) == 32 and row.g == ["ab", "12"] and row.v == "200102_030405.000000" and 0 <= row.u < 1


def test_streams_agree_with_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "events"))
    stream = events.read_events(spark, str(tmp_path / "events"), src.schema)
    got = events.drain(events.windowed(stream), "windows", "complete")
    assert got.agg(F.sum("n")).first()[0] == src.count()
    last = events.drain(events.running_last(stream), "last", "update")
    want = src.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert sorted((r.user_id, r.event_id) for r in last.collect()) == sorted(map(tuple, want.collect()))
