"""Sorted bins, top rows, partitions, batches, caches, and what storage gives back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.dataset import Dataset
from quillon.operators import layout, sorting, transforms
from quillon.operators.position import in_partition
from quillon.plans.entry import catalogue
from quillon.runtime import cut, remove, shared_path, table
from quillon.sources.store import Store

QUERIES, ORACLE, query = catalogue()


@query("SELECT o_orderkey, o_custkey % 8 AS bin, CAST(row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS rank FROM orders")
def bin_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.bin_rank(table(spark, sf_dir, "orders"), "o_custkey % 8", ["o_totalprice", "o_orderkey"]).select("o_orderkey", (F.col("o_custkey") % 8).alias("bin"), "rank")


@query("SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_custkey % 8 AS INTEGER) AS part, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def bin_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, in 8 sorted bins, with the partition and the place there that they really have."""
    rows = Dataset(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).bin_sort(8, "o_custkey", ["o_totalprice", "o_orderkey"]).df
    return in_partition(rows, "part", "place")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def bin_sort_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each key, the least."""
    return Dataset(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"]).bin_sort_by_key(8, unique=True).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).top_k(20, F.desc("o_totalprice"), F.col("o_orderkey")).df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS place FROM lineitem")
def total_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the place that rows have: those of the partitions before, and their own in theirs."""
    rows = Dataset(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")).total_sort("l_extendedprice", "l_orderkey", "l_linenumber").df
    placed = cut(in_partition(rows, "part", "at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each partition
    return placed.join(base, "part").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("base") + F.col("at")).alias("place"))


@query("SELECT event_id, user_id, CAST((user_id - 50 + 12 * 1000000) % 12 AS INTEGER) AS part FROM events")
def repartition_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "events").select("event_id", "user_id")).repartition_by(12, "user_id - 50").df.withColumn("part", F.spark_partition_id())


@query("SELECT user_id, count(*) AS n, CAST(1 AS BIGINT) AS parts FROM events GROUP BY user_id")
def repartition_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key is in one partition."""
    rows = Dataset(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"]).repartition_by_key(12).df.withColumn("part", F.spark_partition_id())
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts"))


@query("SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS part FROM events")
def repartition_by_unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"]).repartition_by_unique_key().df.withColumn("part", F.spark_partition_id())


@query("SELECT CAST(17 AS BIGINT) AS size, count(*) // 17 AS batches FROM part HAVING count(*) >= 17 UNION ALL SELECT count(*) % 17, 1 FROM part HAVING count(*) % 17 > 0")
def rows_reorg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that Python sees, by size, of one partition."""
    rows = layout.rows_reorg(table(spark, sf_dir, "part").select("p_partkey").coalesce(1), 17)
    sizes = transforms.map_batches(rows, lambda t: pa.table({"size": [t.num_rows]}), "size long", rows=17)
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("batches"))


@query("SELECT CAST(6 AS BIGINT) AS jobs, count(*) AS n, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part")
def reorg_with_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over the jobs that have some."""
    rows = Dataset(table(spark, sf_dir, "part").select("p_partkey")).reorg_with_degree(6).df.withColumn("part", F.spark_partition_id())
    return rows.agg(F.count_distinct("part").alias("jobs"), F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def multicast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set that every node has meets another one where its rows lie."""
    every = layout.multicast(table(spark, sf_dir, "nation"))
    return table(spark, sf_dir, "customer").join(every, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def cache_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Dataset(table(spark, sf_dir, "customer").select("c_mktsegment"), ["c_mktsegment"]).cache_in_memory()
    return kept.reduce_by_key(n="count(1)").df


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "store")
    store = Store(spark, root)
    store.save(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "orders")
    out = cut(Dataset(store.load("orders"), ["o_orderstatus"]).reduce_by_key(n="count(1)").df)
    remove(spark, root)
    return out


@query("SELECT count(*) AS length, 1 AS found FROM orders")
def stored_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and wildcard search of stored sets."""
    root = shared_path(spark, "store")
    store = Store(spark, root)
    store.save(table(spark, sf_dir, "orders").select("o_orderkey"), "orders_a")
    told = (store.length("orders_a"), len(store.try_find("orders_*")))
    remove(spark, root)
    return spark.createDataFrame([told], "length long, found int")
