"""Generated and local datasets; these take nothing from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.plans.entry import catalogue
from quillon.sources import generate

QUERIES, ORACLE, query = catalogue()


@query("SELECT CAST(i AS INTEGER) AS part, CAST(i * 100 + j AS BIGINT) AS v FROM range(0, 16) a(i), range(0, 50) b(j)")
def source_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.source_i(spark, 16, lambda i: ((i, i * 100 + j) for j in range(50)), "part int, v long")


@query("SELECT CAST(p AS INTEGER) AS p, CAST(j AS INTEGER) AS idx, CAST(p * 1000 + j AS INTEGER) AS v FROM range(0, 8) a(p), range(0, 24) b(j) WHERE j < (p + 1) * 3")
def init_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition p has 3(p + 1) rows."""
    return generate.init(spark, "(p + 1) * 3", 8, p="p", idx="idx", v="p * 1000 + idx")


@query("SELECT CAST(i AS INTEGER) AS k, CAST(i * i AS INTEGER) AS v FROM range(0, 99) r(i)")
def distribute_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.distribute_n(spark, [(i, i * i) for i in range(99)], "k int, v int", 5)


@query("SELECT CAST(i AS INTEGER) AS k FROM range(0, 100) r(i)")
def distribute_uneven_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.distribute_uneven_n(spark, list(range(100)), "k int", 8)


@query("SELECT CAST(i AS INTEGER) AS k FROM range(0, 10) r(i) UNION ALL SELECT CAST(i + 100 AS INTEGER) FROM range(0, 10) r(i)")
def import_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of sets that two servers export under a name."""
    for k, server in enumerate(("alpha", "beta")):
        generate.export(server, "numbers", lambda s, k=k: s.range(k * 100, k * 100 + 10).selectExpr("cast(id as int) as k"))
    return generate.import_named(spark, ["alpha", "beta"], "numbers")


_LCG = "((i * 1103515245 + {c}) % 1073741824)"


@query(f"WITH p AS (SELECT {_LCG.format(c=12345)} AS x, ((i * 69069 + 7) % 1073741824) AS y FROM range(0, 1000000) r(i)) SELECT 4.0::DOUBLE * count(*) FILTER (x * x + y * y < 1152921504606846976) / 1000000 AS pi FROM p")
def pi_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a number sequence in the unit square: generate, map, reduce."""
    points = generate.init(spark, 125_000, 8, i="cast(p as bigint) * 125000 + idx")
    xy = points.selectExpr("(i * 1103515245 + 12345) % 1073741824 as x", "(i * 69069 + 7) % 1073741824 as y")
    return xy.selectExpr("4.0D * count_if(x * x + y * y < 1073741824L * 1073741824L) / 1000000 as pi")
