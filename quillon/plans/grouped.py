"""Folds, reductions and grouping. Money is added as decimals, so that sums do not depend on order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.dataset import Dataset
from quillon.functions.scalar import words
from quillon.operators import aggregates
from quillon.plans.entry import catalogue
from quillon.runtime import table
from quillon.sources.store import latest, merge_deltas

QUERIES, ORACLE, query = catalogue()


@query("SELECT count(*) AS n FROM orders")
def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "orders")).fold(n="count(1)").df


@query("SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n, max(l_extendedprice) AS most, min(l_shipdate) AS since FROM lineitem")
def fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "lineitem")).fold(total="cast(sum(cast(l_quantity as decimal(18,2))) as double)", n="count(1)", most="max(l_extendedprice)", since="min(l_shipdate)").df


@query("SELECT max(o_totalprice) AS most FROM orders")
def reduce_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = aggregates.reduce_rows(table(spark, sf_dir, "orders"), "o_totalprice", agg="max(o_totalprice)")
    return spark.createDataFrame([(most,)], "most double")


@query("SELECT CAST(bit_xor(CAST(o_orderkey * 31 AS BIGINT)) AS BIGINT) AS x FROM orders")
def reduce_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reducer of one's own, as a Column function."""
    x = aggregates.reduce_rows(table(spark, sf_dir, "orders"), "o_orderkey * 31", merge=lambda a, b: a.bitwiseXOR(b))
    return spark.createDataFrame([(x,)], "x long")


@query("SELECT CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")
def histogram_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "events")).group_by({"bucket": "cast(floor(value / 10) as bigint)"}, aggs={"n": "count(1)"}).df


def _tally(state: dict, row: dict) -> dict:
    """Values of the props' JSON by kind, as Python reads them."""
    for key, value in json.loads(row["props"] or "{}").items():
        kind = (key, type(value).__name__)
        state[kind] = state.get(kind, 0) + 1
    return state


def _join(a: dict, b: dict) -> dict:
    return {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}


_KINDS = "CASE json_type(props, '$.' || k) WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'float' WHEN 'NULL' THEN 'NoneType' WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' ELSE 'int' END"


@query(f"SELECT k AS key, {_KINDS} AS kind, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def fold_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary as state, one for each partition, and a step that columns have no types for."""
    got = aggregates.fold_python(table(spark, sf_dir, "events").select("props"), _tally, _join, {})
    return spark.createDataFrame([(*k, n) for k, n in sorted(got.items())], "key string, kind string, n long")


@query("SELECT o_custkey, CAST(bit_xor(o_orderkey * 31) AS BIGINT) AS x FROM orders GROUP BY o_custkey")
def reduce_by_key_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reducer of one's own by key, as a Column function."""
    return aggregates.reduce_by_key_with(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey * 31", lambda a, b: a.bitwiseXOR(b), "x")


_REVENUE = "cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(20,4))) as double)"


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def reduce_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "lineitem"), ["l_returnflag"]).reduce_by_key(sum_qty="cast(sum(cast(l_quantity as decimal(18,2))) as double)", revenue=_REVENUE, n="count(1)").df


@query("SELECT l_returnflag, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag")
def reduce_by_key_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.reduce_by_key_salted(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "max", "most")


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS order_keys FROM orders GROUP BY o_custkey")
def group_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "orders"), ["o_custkey"]).group_by_key("o_orderkey", "order_keys").df


@query("SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS line_numbers FROM lineitem GROUP BY l_orderkey")
def group_by_key_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset(table(spark, sf_dir, "lineitem"), ["l_orderkey"]).group_by_key_n(16, "l_linenumber", "line_numbers").df


@query("SELECT word AS k, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each word: a row gives each of its words once, and a doc_id counts once."""
    docs = table(spark, sf_dir, "documents")
    pairs = F.transform(F.array_distinct(words("text")), lambda w: F.struct(w.alias("k"), F.col("doc_id").alias("v")))
    return aggregates.map_reduce(docs, pairs, aggs={"docs": "count(distinct v)"})


@query("SELECT o_orderpriority AS k, CAST(sum(o_custkey % 100) AS BIGINT) AS v FROM orders GROUP BY o_orderpriority")
def map_reduce_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a partition function of the key."""
    orders = table(spark, sf_dir, "orders")
    pairs = F.array(F.struct(F.col("o_orderpriority").alias("k"), (F.col("o_custkey") % 100).alias("v")))
    return aggregates.map_reduce(orders, pairs, aggs={"v": "sum(v)"}, partitions=5, partition_by="crc32(k)")


@query("SELECT p_brand AS brand, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_price FROM part GROUP BY p_brand")
def group_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and result selectors."""
    return Dataset(table(spark, sf_dir, "part")).group_by({"brand": "p_brand"}, aggs={"mean_price": "cast(sum(cast(p_retailprice as decimal(18,2))) as double) / count(1)"}).df


@query("SELECT list(p_size ORDER BY p_size) AS sizes FROM part GROUP BY p_type")
def group_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and element selectors; the key is left out."""
    return Dataset(table(spark, sf_dir, "part")).group_by({"type": "p_type"}, element="p_size", name="sizes", keep_key=False).df


@query("SELECT p_brand AS brand, CAST(list_sum(list(p_size)) AS BIGINT) AS total FROM part GROUP BY p_brand")
def group_element_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, element and result selectors, the result being a Column function of the list."""
    return Dataset(table(spark, sf_dir, "part")).group_by({"brand": "p_brand"}, element="p_size", result=lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x), name="total").df


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts: the last one of a key counts."""
    return latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""
WITH e AS (SELECT lower(event_type) AS k, event_id, CAST(value * 100 AS BIGINT) AS v, event_id % 1000 = 0 AS put FROM events),
p AS (SELECT k, max(CASE WHEN put THEN event_id END) AS since FROM e GROUP BY k)
SELECT e.k, CAST(sum(v) AS BIGINT) AS v FROM e JOIN p ON e.k = p.k WHERE since IS NULL OR event_id >= since GROUP BY e.k
""")
def kv_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates add to the last put; keys fold case."""
    e = table(spark, sf_dir, "events")
    return merge_deltas(e.select(F.lower("event_type").alias("k"), F.round(F.col("value") * 100).cast("long").alias("v"), F.col("event_id").alias("seq"), (F.col("event_id") % 1000 == 0).alias("put")))
