"""What brings rows or effects to the client."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession


def to_seq(df: DataFrame) -> Iterator[Row]:
    """Rows partition by partition; a reader that stops early leaves the rest uncomputed."""
    return df.toLocalIterator(prefetchPartitions=True)


def local_iter(df: DataFrame, f: Callable[[Row], None]) -> None:
    for r in to_seq(df):
        f(r)


def print_rows(df: DataFrame, form: str = "{}", n: int = 20) -> None:
    for r in df.take(n):
        print(form.format(*r))


def execute(spark: SparkSession, f: Callable[[], None], n: int | None = None) -> None:
    """Run code in n tasks, by default one for each slot; at least once each."""
    n = n or spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).foreachPartition(lambda _: f())


def run_on_one(spark: SparkSession, f: Callable[[], Any]) -> Any:
    """The result of a function that runs in a single remote task."""
    return spark.sparkContext.parallelize([0], 1).map(lambda _: f()).collect()[0]
