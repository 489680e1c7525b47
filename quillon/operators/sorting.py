"""Sorted bins, total order, first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.transforms import Expr, col


def bin_sort(df: DataFrame, n: int, to: Expr, order: list[Column | str], unique: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Rows in bin pmod(to, n), sorted there; all rows stay.

    With ``unique`` one row of each key stays, the least by ``ties`` (or by all columns), whatever the order of arrival.
    """
    if unique:
        rest = [c for c in df.columns if c not in unique]
        if rest:
            tie = F.struct(*(ties or rest))
            kept = df.groupBy(*unique).agg(F.min_by(F.struct(*rest), tie).alias("_r"))
            df = kept.select(*[F.col(c) if c in unique else F.col(f"_r.{c}") for c in df.columns])
        else:
            df = df.distinct()
    return df.repartitionById(n, F.pmod(col(to), F.lit(n)).cast("int")).sortWithinPartitions(*order)


def bin_sort_by_key(df: DataFrame, n: int, key: str, to: Expr | None = None, unique: bool = False) -> DataFrame:
    return bin_sort(df, n, to if to is not None else F.hash(key), [key], [key] if unique else None)


def bin_rank(df: DataFrame, bin_: Expr, order: list[Column | str], name: str = "rank") -> DataFrame:
    """The 1-based place of each row in its bin; the window's own exchange is the only one."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(col(bin_)).orderBy(*order)))


def total_sort(df: DataFrame, *order: Column | str) -> DataFrame:
    """Ranges over partitions, sorted inside."""
    return df.orderBy(*order)


def take(df: DataFrame, n: int) -> list:
    return df.take(n)


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """A heap of k rows a partition, merged."""
    return df.orderBy(*order).limit(k)
