"""Row-wise operators."""

from __future__ import annotations

import asyncio

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.dataset import Dataset
from quillon.functions.scalar import words
from quillon.operators.position import overall
from quillon.plans.entry import catalogue
from quillon.runtime import table

QUERIES, ORACLE, query = catalogue()


def _of(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> Dataset:
    return Dataset(table(spark, sf_dir, name), list(keys))


@query("SELECT * FROM region")
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "region").identity().df


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_quantity="l_quantity").df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def map_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "lineitem").map(l_orderkey="l_orderkey", l_linenumber="l_linenumber", net="l_extendedprice * (1 - l_discount)").df


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE event_type = 'purchase' AND value IS NOT NULL")
def choose_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "events").choose(event_id="event_id", doubled="case when event_type = 'purchase' then value * 2 end").df


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def flatmap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _of(spark, sf_dir, "documents").flat_map(words("text"), "word").df
    return Dataset(flat, ["word"]).reduce_by_key(n="count(1)").df


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS idx, o_totalprice FROM orders")
def mapi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions over the whole set; those of single partitions follow the layout, which SQL has not."""
    return overall(table(spark, sf_dir, "orders"), "o_orderkey", name="idx").select("o_orderkey", "idx", "o_totalprice")


@query("SELECT count(*) AS n, count(*) AS distinct_places, CAST(0 AS BIGINT) AS first_place FROM orders")
def mapi_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(partition, index) of mapi name each row once, from 0 in each partition."""
    placed = _of(spark, sf_dir, "orders").mapi().df
    by_part = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("d"), F.min("idx").alias("lo"))
    return by_part.agg(F.sum("n").alias("n"), F.sum("d").alias("distinct_places"), F.max("lo").alias("first_place"))


def _upper(t: pa.Table) -> pa.Table:
    return pa.table({"p_partkey": t.column("p_partkey"), "shout": pc.utf8_upper(t.column("p_name"))})


@query("SELECT p_partkey, upper(p_name) AS shout FROM part")
def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _of(spark, sf_dir, "part").select(p_partkey="p_partkey", p_name="p_name")
    return parts.map_batches(_upper, "p_partkey long, shout string", rows=64).df


async def _area(r: dict) -> dict:
    await asyncio.sleep(0)
    return {"s_suppkey": r["s_suppkey"], "zone": r["s_nationkey"] // 5}


@query("SELECT s_suppkey, CAST(s_nationkey // 5 AS INTEGER) AS zone FROM supplier")
def async_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "supplier").async_map(_area, "s_suppkey long, zone int").df


def _even_only(r: dict) -> dict:
    if r["c_custkey"] % 2:
        raise ValueError("odd")
    return {"c_custkey": r["c_custkey"], "name": r["c_name"].lower()}


@query("SELECT c_custkey, lower(c_name) AS name FROM customer WHERE c_custkey % 2 = 0")
def parallel_map_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row whose task fails is dropped alone."""
    return _of(spark, sf_dir, "customer").parallel_map(_even_only, "c_custkey long, name string", on_error="drop").df


@query("SELECT o_custkey, o_totalprice FROM orders WHERE o_custkey % 7 = 3")
def filter_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "orders", "o_custkey").filter_by_key("o_custkey % 7 = 3").select(o_custkey="o_custkey", o_totalprice="o_totalprice").df


@query("SELECT o_custkey, o_totalprice * 2 AS twice FROM orders")
def map_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "orders", "o_custkey").map_by_value(twice="o_totalprice * 2").df


async def _slow_size(v: dict) -> dict:
    await asyncio.sleep(0)
    return {"size2": v["p_size"] * 2}


@query("SELECT p_partkey, CAST(p_size * 2 AS INTEGER) AS size2 FROM part")
def async_map_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = Dataset(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"])
    return parts.async_map_by_value(_slow_size, "p_partkey long, size2 int").df


@query("SELECT p_partkey, CAST(p_size + 1 AS INTEGER) AS size1 FROM part")
def parallel_map_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = Dataset(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"])
    return parts.parallel_map_by_value(lambda v: {"size1": v["p_size"] + 1}, "p_partkey long, size1 int").df
