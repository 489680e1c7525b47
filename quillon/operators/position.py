"""Row positions: inside partitions as they lie, and over the whole in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import cut

PART, INDEX = "_part", "_index"
_LOW = (1 << 33) - 1


def in_partition(df: DataFrame, part: str = PART, index: str = INDEX) -> DataFrame:
    """Partition number and 0-based position there; narrow, so it follows the layout that the plan has just here."""
    return df.select(F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(_LOW).alias(index), *df.columns)


def overall(df: DataFrame, *order: Column | str, name: str = INDEX) -> DataFrame:
    """0-based position over all rows in ``order``.

    Rows are dealt by ranges, numbered inside each and moved up by the rows of the ranges before; the layout is
    checkpointed, as a second run of the sampling might cut elsewhere. Only one row for each range is summed in one place.
    """
    placed = cut(in_partition(df.repartitionByRange(*order).sortWithinPartitions(*order)))
    sizes = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select(PART, F.coalesce(F.sum("_n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), PART).select((F.col("_base") + F.col(INDEX)).cast("long").alias(name), *df.columns)  # a row for each range
