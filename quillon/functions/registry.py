"""Named functions: registered once, called by name from SQL, from DataFrames or on one remote task."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from quillon.operators.actions import execute, run_on_one

_PLANS: dict[str, Callable[..., DataFrame]] = {}
_CALLS: dict[str, Callable[..., Any]] = {}


def register_scalar(spark: SparkSession, name: str, f: Callable, returns: str, vectorised: bool = True) -> None:
    """A function of pandas Series (or of plain values) for SQL."""
    from pyspark.sql.functions import pandas_udf, udf

    spark.udf.register(name, (pandas_udf if vectorised else udf)(f, returns))


def register_plan(name: str, f: Callable[..., DataFrame]) -> None:
    """A function from a session and arguments to a dataset: a sequence function of the platform."""
    _PLANS[name] = f


def import_plan(spark: SparkSession, name: str, *args: Any) -> DataFrame:
    return _PLANS[name](spark, *args)


def stream_plan(spark: SparkSession, name: str, *args: Any) -> Iterator[Row]:
    """The rows of a named plan as they come, a partition at a time, for a caller that does not hold them all."""
    yield from import_plan(spark, name, *args).toLocalIterator(prefetchPartitions=True)


async def call_async(spark: SparkSession, name: str, *args: Any, everywhere: bool = False) -> Any:
    """As call, awaited: several calls run side by side."""
    return await asyncio.to_thread(call, spark, name, *args, everywhere=everywhere)


def register_call(name: str, f: Callable[..., Any]) -> None:
    _CALLS[name] = f


def call(spark: SparkSession, name: str, *args: Any, everywhere: bool = False) -> Any:
    """Run a registered function in one remote task, or once for each slot without a result."""
    f = _CALLS[name]
    return execute(spark, lambda: f(*args)) if everywhere else run_on_one(spark, lambda: f(*args))
