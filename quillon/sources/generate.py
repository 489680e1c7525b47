"""Generated and local datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quillon.operators.transforms import Expr, named

#: Rows of a generator that make one Arrow batch.
BATCH = 1000


def nodes(spark: SparkSession) -> int:
    """Executors, the driver of a local session counting as one."""
    return max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)


def source_i(spark: SparkSession, partitions: int, f: Callable[[int], Iterable[Any]], schema: str | StructType) -> DataFrame:
    """Exactly so many generators, each called with its number. A lost partition is generated again."""
    want = spark.createDataFrame([], schema).schema
    names = want.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(want)

    def run(batches):
        for b in batches:
            for part in b.column(0).to_pylist():
                held: list[tuple] = []
                for row in f(part):
                    held.append(row if isinstance(row, tuple) else (row,))
                    if len(held) == BATCH:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)

    return spark.range(0, partitions, 1, max(1, partitions)).mapInArrow(run, want)


def source(spark: SparkSession, f: Callable[[], Iterable[Any]], schema: str | StructType) -> DataFrame:
    """One generator for each node."""
    return source_i(spark, nodes(spark), lambda _: f(), schema)


def source_n(spark: SparkSession, num: int, f: Callable[[int], Iterable[Any]], schema: str | StructType) -> DataFrame:
    """``num`` generators for each node, called with their number there."""
    return source_i(spark, nodes(spark) * num, lambda i: f(i % num), schema)


def init(spark: SparkSession, size: Expr | int, partitions: int | None = None, **exprs: Expr) -> DataFrame:
    """Rows (p, idx) with idx from 0 below ``size`` (over p and parts), projected; made and kept in Spark's own columns."""
    parts = nodes(spark) if partitions is None else partitions
    if not parts:
        return spark.range(0).select(F.col("id").cast("int").alias("p"), F.lit(0).alias("idx")).select(*(named(exprs) or ["*"]))
    n: Column = F.lit(size) if isinstance(size, int) else (F.expr(size) if isinstance(size, str) else size)
    rows = spark.range(0, parts, 1, parts).select(F.col("id").cast("int").alias("p"), F.lit(parts).alias("parts"))
    rows = rows.withColumn("_n", n.cast("int")).where("_n > 0")
    rows = rows.select("p", "parts", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("idx"))
    return rows.select(*named(exprs)) if exprs else rows.select("p", "idx")


def init_s(spark: SparkSession, size: int, partitions: int | None = None, **exprs: Expr) -> DataFrame:
    return init(spark, size, partitions, **exprs)


def init_n(spark: SparkSession, parallel: int, size: Expr | int, **exprs: Expr) -> DataFrame:
    """``parallel`` partitions for each node; none gives no rows."""
    return init(spark, size, nodes(spark) * parallel, **exprs)


def _cut(rows: Sequence, cuts: list[int], schema: Any, spark: SparkSession) -> DataFrame:
    """Local rows in given contiguous ranges, one partition each, in their order."""
    bounds = list(zip(cuts[:-1], cuts[1:], strict=True))
    numbered = [(k, i, *(r if isinstance(r, tuple) else (r,))) for k, (a, z) in enumerate(bounds) for i, r in enumerate(rows[a:z])]
    want = spark.createDataFrame([], schema).schema
    wide = StructType().add("_to", IntegerType()).add("_at", IntegerType())
    for f in want.fields:
        wide.add(f)
    df = spark.createDataFrame(numbered, wide)
    return df.repartitionById(max(1, len(bounds)), F.col("_to")).sortWithinPartitions("_at").drop("_to", "_at")


def distribute_n(spark: SparkSession, rows: Sequence, schema: Any, num: int = 1) -> DataFrame:
    """Local rows in ``num`` ranges for each node, each of the rounded-up share."""
    n = nodes(spark) * num
    share = -(-len(rows) // n)
    return _cut(rows, [min(len(rows), k * share) for k in range(n + 1)], schema, spark)


def distribute(spark: SparkSession, rows: Sequence, schema: Any) -> DataFrame:
    return distribute_n(spark, rows, schema, 1)


def distribute_uneven_n(spark: SparkSession, rows: Sequence, schema: Any, num: int) -> DataFrame:
    """Ranges of the rounded-down share; the last takes the rest."""
    n = nodes(spark) * num
    share = len(rows) // n
    return _cut(rows, [*(k * share for k in range(n)), len(rows)], schema, spark)


_EXPORTS: dict[tuple[str, str], Callable[[SparkSession], DataFrame]] = {}


def export(server: str, name: str, reader: Callable[[SparkSession], DataFrame]) -> None:
    """Offer a named dataset for import_named."""
    _EXPORTS[server, name] = reader


def import_named(spark: SparkSession, servers: Sequence[str], *names: str) -> DataFrame:
    """The union of named datasets over servers; an unknown name raises KeyError."""
    from quillon.operators.combine import merge

    return merge(*(_EXPORTS[s, n](spark) for s in servers for n in names))
