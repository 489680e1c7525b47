"""Connected components and gapless ranks that hold no key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels (node, component) of an undirected edge list (u, v) of longs; component is the least node reachable.

    Alternating large-star and small-star rounds, each checkpointed, until the edge set is a forest of stars.
    Only sums reach the driver. Self loops, repeated and reversed edges are allowed; an empty list gives no rows.
    """

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node sends its smaller neighbours, and itself, to the least of them
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(mins.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("v").alias("node")).agg(F.first("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: Rows of a key that one task ranks, about.
RANKED_ROWS = 200_000


def salts_for(rows: int) -> int:
    """Over how many tasks the rows of a key are dealt."""
    return 16 + rows // RANKED_ROWS


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "rank", salts: Column | int = 64) -> DataFrame:
    """0-based positions within ``keys``, gapless, with each key dealt over ``salts`` tasks (a number, or one for each key).

    Order inside a salt follows ``order``; between salts it is the salt's number, so any total numbering is reached
    without sorting one key's rows in one task. ``order`` must identify rows of a key (ties would be numbered freely).
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts) if isinstance(salts, int) else salts).cast("int"))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rn", F.row_number().over(w) - 1)
    return ranked.join(starts, [*keys, "_salt"]).withColumn(out, (F.col("_rn") + F.col("_base")).cast("long")).drop("_rn", "_base", "_salt")
