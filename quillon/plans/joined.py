"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.dataset import Dataset
from quillon.operators import joins
from quillon.plans.entry import catalogue
from quillon.runtime import table

QUERIES, ORACLE, query = catalogue()


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Dataset(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])
    return orders.inner_join(Dataset(table(spark, sf_dir, "customer")), o_orderkey="o_orderkey", o_totalprice="o_totalprice", c_name="c_name").df


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def left_join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = Dataset(table(spark, sf_dir, "customer"), ["c_custkey"])
    return customer.left_outer_join(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), c_custkey="c_custkey", o_orderkey="o_orderkey", o_totalprice="o_totalprice").df


@query("SELECT p_partkey, s_name FROM (SELECT s_suppkey, s_name FROM supplier) RIGHT JOIN part ON s_suppkey = p_partkey")
def right_join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = Dataset(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "p_partkey"), ["p_partkey"])
    return supplier.right_outer_join(table(spark, sf_dir, "part"), p_partkey="p_partkey", s_name="s_name").df


@query("""
WITH a AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
b AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
SELECT a.k, c_custkey, s_suppkey FROM a LEFT JOIN b ON a.k = b.k AND a.i = b.i
""")
def join_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal keys zipped, as a single pass over two sorted sides does."""
    a = table(spark, sf_dir, "customer").selectExpr("c_nationkey as k", "c_custkey")
    b = table(spark, sf_dir, "supplier").selectExpr("s_nationkey as k", "s_suppkey")
    return joins.left_outer_join(a, b, ["k"], one_to_one=True, order_a=["c_custkey"], order_b=["s_suppkey"], k="k", c_custkey="c_custkey", s_suppkey="s_suppkey")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "nation")).cross_join(Dataset(table(spark, sf_dir, "region")), n_name="n_name", r_name="r_name").df


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "nation")).cross_join_choose(Dataset(table(spark, sf_dir, "region")), "n_regionkey < r_regionkey", n_name="n_name", r_name="r_name").df


@query("SELECT s_suppkey, CAST(sum((s_nationkey + n_nationkey) % 7) AS BIGINT) AS total, count(*) AS n FROM supplier CROSS JOIN nation GROUP BY s_suppkey")
def cross_join_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "supplier")).cross_join_fold(Dataset(table(spark, sf_dir, "nation")), ["s_suppkey"], {"total": "sum((s_nationkey + n_nationkey) % 7)", "n": "count(1)"}).df


@query("SELECT s_suppkey, CAST(0 AS BIGINT) AS total FROM supplier")
def cross_join_fold_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty other side gives the seed for each row."""
    return Dataset(table(spark, sf_dir, "supplier")).cross_join_fold(table(spark, sf_dir, "nation").where("n_nationkey < 0"), ["s_suppkey"], {"total": "sum(n_nationkey)"}, {"total": "0L"}).df


@query("SELECT c_custkey, CAST(sum(CASE WHEN n_regionkey = c_nationkey % 5 THEN n_nationkey ELSE 1 END) AS BIGINT) AS score FROM customer CROSS JOIN nation GROUP BY c_custkey")
def cross_join_fold_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of one's own, without a shuffle."""
    from pyspark.sql import functions as F

    def step(s, n):
        return s + F.when(n.n_regionkey == F.col("c_nationkey") % 5, n.n_nationkey).otherwise(F.lit(1)).cast("long")

    got = joins.cross_join_fold_array(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "0L", step, "score")
    return got.select("c_custkey", "score")
