"""Equi-joins, products, theta joins and folds over products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.layout import BROADCAST_BYTES, multicast
from quillon.operators.transforms import Expr, col, named, unused
from quillon.runtime import ship


def merge_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", one_to_one: bool = False, order_a: list[str] | None = None, order_b: list[str] | None = None, **exprs: Expr) -> DataFrame:
    """An equi-join on keys; missing sides are null.

    With ``one_to_one`` equal keys are zipped in the given orders rather than multiplied: the n-th row of a key on one
    side meets the n-th on the other.
    """
    if how not in ("inner", "left", "right"):
        raise ValueError("how is 'inner', 'left' or 'right'")
    on = list(keys)
    if one_to_one:
        nth = unused("_nth", a, b)
        a, b = (d.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*(o or keys)))) for d, o in ((a, order_a), (b, order_b)))
        on.append(nth)
    out = a.join(b, on, how)
    return out.select(*named(exprs)) if exprs else (out.drop(nth) if one_to_one else out)


def inner_join(a: DataFrame, b: DataFrame, keys: list[str], **more) -> DataFrame:
    return merge_join(a, b, keys, "inner", **more)


def left_outer_join(a: DataFrame, b: DataFrame, keys: list[str], **more) -> DataFrame:
    return merge_join(a, b, keys, "left", **more)


def right_outer_join(a: DataFrame, b: DataFrame, keys: list[str], **more) -> DataFrame:
    return merge_join(a, b, keys, "right", **more)


def cross_join(x: DataFrame, small: DataFrame, **exprs: Expr) -> DataFrame:
    """All pairs; the smaller side goes to every node if its estimate allows, else Spark pairs partitions."""
    out = x.crossJoin(multicast(small))
    return out.select(*named(exprs)) if exprs else out


def cross_join_choose(x: DataFrame, small: DataFrame, on: Expr, **exprs: Expr) -> DataFrame:
    """The pairs that meet a condition (a theta join); equalities in it become a hash or merge join."""
    out = x.join(multicast(small), col(on), "inner")
    return out.select(*named(exprs)) if exprs else out


def cross_join_fold(x: DataFrame, small: DataFrame, keys: list[str], aggs: dict[str, Expr], empty: dict[str, Expr] | None = None) -> DataFrame:
    """One row for each key of x: aggregates over its pairs with all rows of the other side.

    ``keys`` identify the rows of x. A row's pairs are made in one task, so its partial aggregate is a single row
    before the shuffle. Where the other side is empty, ``empty`` gives the values.
    """
    if empty is None:
        return x.crossJoin(multicast(small)).groupBy(*keys).agg(*named(aggs))
    there = unused("_there", x, small)
    paired = x.join(multicast(small.withColumn(there, F.lit(1))), F.lit(True), "left")
    got = paired.groupBy(*keys).agg(*named(aggs), F.count(there).alias(there))
    return got.select(*keys, *[F.when(F.col(there) > 0, F.col(k)).otherwise(col(empty[k])).alias(k) for k in aggs])


def cross_join_fold_array(x: DataFrame, small: DataFrame, seed: Expr, step: Callable[[Column, Column], Column], name: str, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """As cross_join_fold with any Column step and no shuffle: the other side, of checked bytes, is one array."""
    sizes = small.select(F.octet_length(F.to_json(F.struct(*small.columns))).alias("n"))
    told = sizes.agg(F.sum("n")).first()[0] or 0
    if told > limit_bytes:
        raise ValueError(f"the folded side has more than {limit_bytes} bytes; use cross_join_fold")
    every = unused("_all", x, small)
    one = small.agg(F.array_sort(F.collect_list(F.struct(*small.columns))).alias(every))
    return x.crossJoin(F.broadcast(one)).withColumn(name, F.aggregate(every, col(seed), step)).drop(every)  # one row, limit_bytes as text


def pairs_fold(df: DataFrame, fold: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str, groups: int) -> DataFrame:
    """A fold over all pairs of a set's own rows, in cells of a triangle.

    Rows fall into ``groups`` groups by their hash. Each two groups are a task, as is each group by itself; it holds these
    rows and gives what ``fold(a, b)`` makes of the pairs of a row of a and one of b, or with b None of the pairs within a.
    A row is sent once for each group, so with as many groups as rows are for a task's memory no task grows with the set.
    """
    ship(df.sparkSession)
    own, other, cell, side = (unused(n, df) for n in ("_own", "_other", "_cell", "_side"))
    high = F.greatest(own, other)
    dealt = df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(groups)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.withColumn(cell, (high * (high + 1) / 2 + F.least(own, other)).cast("int")).withColumn(side, F.signum(F.col(own) - F.col(other)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        whole = pa.Table.from_batches(got) if got else None
        for c in pc.unique(whole[cell]).to_pylist() if got else []:
            there = whole.filter(pc.equal(whole[cell], c))
            low, within, up = (there.filter(pc.equal(there[side], k)).drop_columns([cell, side]) for k in (-1, 0, 1))
            if within.num_rows:
                yield from fold(within, None).to_batches()
            elif low.num_rows and up.num_rows:
                yield from fold(low, up).to_batches()

    return dealt.drop(own, other).repartitionById(groups * (groups + 1) // 2, F.col(cell)).mapInArrow(run, schema)
