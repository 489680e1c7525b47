"""Unions, positional zips, splits and shared branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.position import INDEX, PART, in_partition, overall
from quillon.operators.transforms import Expr, named
from quillon.runtime import cut


def merge(*dfs: DataFrame) -> DataFrame:
    """A bag union; partitions add up."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def zip_rows(dfs: list[DataFrame], orders: list[list[str]] | None = None, check: bool = True, **exprs: Expr) -> DataFrame:
    """Row n of each side by side; ``exprs`` project.

    With ``orders`` rows are aligned by their place in these orders. Without, by partition and place there as the
    sides lie, which is checkpointed. Sides of unequal length raise ValueError.
    """
    if orders:
        placed, on = [overall(d, *o) for d, o in zip(dfs, orders, strict=True)], [INDEX]
    else:
        placed, on = [cut(in_partition(d)) for d in dfs], [PART, INDEX]
    if check:
        sizes = [[tuple(r) for r in p.groupBy(*on[:-1]).count().collect()] if len(on) > 1 else p.count() for p in placed]
        if any((sorted(s) if isinstance(s, list) else s) != (sorted(sizes[0]) if isinstance(s, list) else sizes[0]) for s in sizes):
            raise ValueError("the sides to zip differ in length or partitions")
    out = reduce(lambda a, b: a.join(b, on), placed).drop(*on)
    return out.select(*named(exprs)) if exprs else out


def mix(dfs: list[DataFrame], names: list[str] | None = None, **more) -> DataFrame:
    """A zip to structs."""
    names = names or [f"_{i + 1}" for i in range(len(dfs))]
    boxed = [d.select(F.struct(*d.columns).alias(n), *([F.col(c).alias(f"_o_{n}_{c}") for c in o] if o else [])) for d, n, o in zip(dfs, names, more.get("orders") or [None] * len(dfs), strict=True)]
    orders = [[f"_o_{n}_{c}" for c in o] for n, o in zip(names, more["orders"], strict=True)] if more.get("orders") else None
    return zip_rows(boxed, orders, more.get("check", True)).select(*names)


def split(df: DataFrame, *branches: dict[str, Expr]) -> list[DataFrame]:
    """Projections of one dataset, each with the hidden row id that rejoin() aligns them by."""
    own = cut(in_partition(df))
    return [own.select(PART, INDEX, *named(b)) for b in branches]


def rejoin(branches: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, [PART, INDEX]), branches).drop(PART, INDEX)


class Bypass:
    """Several branches over rows computed once: kept in memory and on disk while the block lasts."""

    def __init__(self, df: DataFrame, n: int = 2):
        self.df, self.n = df, n

    def __enter__(self) -> list[DataFrame]:
        self.df.persist()
        return [self.df] * self.n

    def __exit__(self, *_) -> None:
        self.df.unpersist()
