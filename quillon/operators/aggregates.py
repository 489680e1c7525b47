"""Folds, reductions and grouping. Built-in aggregates combine before the shuffle; Python folds send one state a partition."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import reduce as _reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quillon.operators.transforms import Expr, col, named
from quillon.runtime import cut

#: Values that a round of reduce_rows merges in one list.
CHUNK = 4096


def fold(df: DataFrame, **aggs: Expr) -> DataFrame:
    """One row of built-in aggregates over all rows, in one pass."""
    return df.agg(*named(aggs))


def fold_python(df: DataFrame, step: Callable[[Any, dict], Any], combine: Callable[[Any, Any], Any], seed: Any, seeding: str = "once") -> Any:
    """Fold arbitrary states: a partial state in each partition, combined on the driver in order of partitions.

    ``combine`` must be associative and commutative. With ``seeding='per_partition'`` each partition begins from the
    seed, empty ones too; with 'once' partitions begin from their first row's step over the seed, and the seed must be
    neutral to ``combine``. Null states are skipped. States are pickled, one to a partition.
    """
    if seeding not in ("once", "per_partition"):
        raise ValueError("seeding is 'once' or 'per_partition'")
    raw = pickle.dumps(seed)

    def run(batches):
        state, touched = pickle.loads(raw), seeding == "per_partition"
        for b in batches:
            for row in b.to_pylist():
                state, touched = step(state, row), True
        if touched and state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    states = [pickle.loads(r.state) for r in df.mapInArrow(run, "state binary").toLocalIterator()]
    return _reduce(combine, states) if states else seed


def reduce_rows(df: DataFrame, value: Expr, merge: Callable[[Column, Column], Column] | None = None, agg: Expr | None = None) -> Any:
    """One value of all rows: by a built-in aggregate, or by a Column merge in rounds over lists of ``CHUNK`` values.

    ``merge`` must be associative and commutative; it sees no nulls. Raises ValueError where there is no value.
    """
    if agg is not None:
        got = df.agg(col(agg).alias("v"), F.count(F.lit(1)).alias("n")).first()
        if not got.n:
            raise ValueError("No result: the dataset is empty")
        return got.v
    left = df.select(col(value).alias("v")).where("v is not null")
    while True:
        lists = _lists(left)
        rest = F.slice("vs", 2, F.greatest(F.size("vs") - 1, F.lit(0)))
        left = cut(lists.select(F.reduce(rest, F.col("vs")[0], merge).alias("v")))
        n = left.count()
        if not n:
            raise ValueError("No result: the dataset is empty")
        if n == 1:
            return left.first().v
        left = left.repartition(-(-n // CHUNK))


def _lists(values: DataFrame) -> DataFrame:
    """Lists of up to CHUNK values, made where the values lie: nothing is moved."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                own = b.column(0).slice(at, CHUNK)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], names=["vs"])

    return values.mapInArrow(run, StructType([StructField("vs", ArrayType(values.schema["v"].dataType))]))


def reduce_by_key_with(df: DataFrame, keys: list[str], value: Expr, merge: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
    """One value for each key by a Column merge of one's own, associative and commutative; it sees no nulls.

    Values are merged in lists of up to ``CHUNK`` for each key and task-sized chunk, then those results again, until each
    key has one: a key with very many values is merged by as many tasks as it has chunks.
    """
    left = df.select(*keys, col(value).alias("_v")).where("_v is not null")
    rest = F.slice("_vs", 2, F.greatest(F.size("_vs") - 1, F.lit(0)))
    while True:
        own = left.withColumn("_c", F.floor(F.monotonically_increasing_id() / CHUNK))
        lists = own.groupBy(*keys, "_c").agg(F.collect_list("_v").alias("_vs"))
        merged = cut(lists.select(*keys, F.reduce(rest, F.col("_vs")[0], merge).alias("_v")))
        most = merged.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if most <= CHUNK:
            last = merged.groupBy(*keys).agg(F.collect_list("_v").alias("_vs"))
            return last.select(*keys, F.reduce(rest, F.col("_vs")[0], merge).alias(name))
        left = merged.repartition(*keys).sortWithinPartitions(*keys)  # a key's results lie together in the next round


def reduce_by_key(df: DataFrame, keys: list[str], **aggs: Expr) -> DataFrame:
    """Built-in aggregates by key, combined before the shuffle."""
    return df.groupBy(*keys).agg(*named(aggs))


def reduce_by_key_salted(df: DataFrame, keys: list[str], value: Expr, merge: str, name: str, salts: int = 16) -> DataFrame:
    """A sum, min, max or count by key in two steps, for keys that partial aggregation alone does not tame."""
    two = {"sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max), "count": (F.count, F.sum)}[merge]
    part = df.select(*keys, col(value).alias("_v"), F.pmod(F.xxhash64(*df.columns), F.lit(salts)).alias("_s"))
    return part.groupBy(*keys, "_s").agg(two[0]("_v").alias("_v")).groupBy(*keys).agg(two[1]("_v").alias(name))


def group_by_key(df: DataFrame, keys: list[str], value: Expr, name: str = "values", ordered: bool = True) -> DataFrame:
    """The list of a key's values; sorted unless told otherwise, as the order of arrival is nobody's."""
    got = F.collect_list(col(value))
    return df.groupBy(*keys).agg((F.array_sort(got) if ordered else got).alias(name))


def group_by_key_n(df: DataFrame, n: int, keys: list[str], value: Expr, name: str = "values") -> DataFrame:
    """As group_by_key; the number is a hint without effect on rows."""
    return group_by_key(df, keys, value, name)


def group_result(df: DataFrame, key: dict[str, Expr], element: Expr | None = None, result: Callable[[Column], Column] | None = None, name: str = "result", keep_key: bool = True, aggs: dict[str, Expr] | None = None) -> DataFrame:
    """Grouping with key, element and result selectors; built-in ``aggs`` replace a list and its result."""
    if aggs:
        out = df.groupBy(*named(key)).agg(*named(aggs))
        return out if keep_key else out.drop(*key)
    items = F.array_sort(F.collect_list(col(element) if element is not None else F.struct(*df.columns)))
    out = df.groupBy(*named(key)).agg(items.alias(name))
    out = out.withColumn(name, result(F.col(name))) if result else out
    return out if keep_key else out.drop(*key)


def map_reduce(df: DataFrame, pairs: Expr, result: Callable[[Column], Column] | None = None, aggs: dict[str, Expr] | None = None, partitions: int | None = None, partition_by: Expr | None = None) -> DataFrame:
    """Flat-map to structs (k, v), group by k, reduce. ``aggs`` over k and v are combined before the shuffle."""
    kv = df.select(F.explode(col(pairs)).alias("_p")).select("_p.k", "_p.v")
    if partitions:
        kv = kv.repartitionById(partitions, F.pmod(col(partition_by), F.lit(partitions)).cast("int")) if partition_by is not None else kv.repartition(partitions, "k")
    if aggs:
        return kv.groupBy("k").agg(*named(aggs))
    out = kv.groupBy("k").agg(F.collect_list("v").alias("v"))
    return out.withColumn("v", result(F.col("v"))) if result else out


def count(df: DataFrame) -> int:
    return df.count()


def iterate(df: DataFrame, f: Callable[[Any], None]) -> None:
    """A side effect for each row, at least once."""

    def run(rows) -> None:
        for r in rows:
            f(r)

    df.foreachPartition(run)
