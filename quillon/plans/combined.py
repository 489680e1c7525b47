"""Unions, positional zips, splits and shared branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.dataset import Dataset
from quillon.operators import combine
from quillon.plans.entry import catalogue
from quillon.runtime import table

QUERIES, ORACLE, query = catalogue()


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation")
def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Dataset(table(spark, sf_dir, "supplier")).map(k="s_suppkey", name="s_name")
    b = Dataset(table(spark, sf_dir, "customer")).map(k="c_custkey", name="c_name")
    c = Dataset(table(spark, sf_dir, "nation")).map(k="cast(n_nationkey as bigint)", name="n_name")
    return a.merge(b, c).df


@query("SELECT p_partkey, p_name, CAST(p_size * 2 AS INTEGER) AS size2, p_retailprice + 1 AS dearer FROM part")
def split_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three branches of one parent, put side by side again by their hidden row id."""
    return combine.rejoin(combine.split(table(spark, sf_dir, "part"), {"p_partkey": "p_partkey", "p_name": "p_name"}, {"size2": "p_size * 2"}, {"dearer": "p_retailprice + 1"}))


_ZIP = """
WITH a AS (SELECT o_orderkey AS early, o_custkey AS k, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
b AS (SELECT o_orderkey AS cheap, o_custkey AS m, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders)
"""


def _sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All orders twice, to be lined up by their dates and by their prices."""
    orders = table(spark, sf_dir, "orders")
    return [orders.selectExpr("o_orderkey as early", "o_custkey as k", "o_orderdate as since"), orders.selectExpr("o_orderkey as cheap", "o_custkey as m", "o_totalprice as price")]


@query(_ZIP + "SELECT early, cheap, k + m AS customers FROM a JOIN b USING (i)")
def zip_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.zip_rows(_sides(spark, sf_dir), [["since", "early"], ["price", "cheap"]], early="early", cheap="cheap", customers="k + m")


@query(_ZIP + ", c AS (SELECT o_orderkey AS other, row_number() OVER (ORDER BY o_orderkey DESC) AS i FROM orders) SELECT early, cheap, other FROM a JOIN b USING (i) JOIN c USING (i)")
def mix_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs of three whole sides, the third one backwards."""
    sides = _sides(spark, sf_dir)
    back = sides[0].selectExpr("early as other", "-early as place")
    got = combine.mix([*sides, back], ["a", "b", "c"], orders=[["since", "early"], ["price", "cheap"], ["place"]])
    return got.select("a.early", "b.cheap", "c.other")


@query("SELECT 'all' AS branch, count(*) AS n FROM events UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events")
def bypass_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three branches over rows computed once; the block ends with their results at hand."""
    with Dataset(table(spark, sf_dir, "events").select("user_id", "event_type")).bypass(3) as (a, b, c):
        rows = [("all", a.count()), ("errors", b.where("event_type = 'error'").count()), ("users", c.select("user_id").distinct().count())]
    return spark.createDataFrame(rows, "branch string, n long")
