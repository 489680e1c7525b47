"""Row-wise operators. Columns and SQL strings stay visible to the optimiser; Python comes in by batches only."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.position import in_partition

Expr = Column | str


def col(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def named(exprs: dict[str, Expr]) -> list[Column]:
    return [col(e).alias(k) for k, e in exprs.items()]


def unused(name: str, *dfs: DataFrame) -> str:
    """A name like this that no column has."""
    taken = {c.lower() for d in dfs for c in d.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identity(df: DataFrame) -> DataFrame:
    return df.select("*")


def filter_rows(df: DataFrame, pred: Expr) -> DataFrame:
    return df.where(col(pred))


def choose(df: DataFrame, **exprs: Expr) -> DataFrame:
    """Project, then keep rows of which every projected value is there."""
    return df.select(*named(exprs)).dropna(how="any")


def map_rows(df: DataFrame, **exprs: Expr) -> DataFrame:
    return df.select(*named(exprs))


def mapi(df: DataFrame, part: str = "part", index: str = "idx", **exprs: Expr) -> DataFrame:
    """Project with the partition number and the 0-based position in it."""
    own = in_partition(df, part, index)
    return own.select(part, index, *named(exprs)) if exprs else own


def flat_map(df: DataFrame, array: Expr, name: str, *keep: Expr) -> DataFrame:
    """A row for each element of an array; rows with null or empty arrays give none."""
    return df.select(*[col(k) if isinstance(k, Column) else F.col(k) for k in keep], F.explode(col(array)).alias(name))


def map_batches(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: Any, rows: int | None = None) -> DataFrame:
    """Arrow tables in and out; ``rows`` re-cuts the batches that f sees (0: the whole partition at once)."""

    def run(batches: Iterable[pa.RecordBatch]):
        if rows is None:
            for b in batches:
                yield from f(pa.Table.from_batches([b])).to_batches()
            return
        held: list[pa.RecordBatch] = []
        have = 0
        for b in batches:
            while b.num_rows:
                take = b.num_rows if rows == 0 else min(b.num_rows, rows - have)
                held.append(b.slice(0, take))
                have, b = have + take, b.slice(take)
                if rows and have == rows:
                    yield from f(pa.Table.from_batches(held)).to_batches()
                    held, have = [], 0
        if have:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return df.mapInArrow(run, schema)


def _per_row(df: DataFrame, schema: Any, on_error: str, run_all: Callable[[list[dict]], list[Any]]) -> DataFrame:
    if on_error not in ("raise", "drop"):
        raise ValueError("on_error is 'raise' or 'drop'")

    def run(batches):
        for pdf in batches:
            out = run_all(pdf.to_dict("records"))
            failed = [x for x in out if isinstance(x, BaseException)]
            if failed and on_error == "raise":
                raise failed[0]
            yield pd.DataFrame([x for x in out if not isinstance(x, BaseException)])

    # an empty frame needs the columns that the schema names
    names = list(df.sparkSession.createDataFrame([], schema).columns) if isinstance(schema, str) else schema.fieldNames()

    def shaped(batches):
        for out in run(batches):
            yield out.reindex(columns=names)

    return df.mapInPandas(shaped, schema)


def async_map(df: DataFrame, f: Callable[[dict], Awaitable[dict]], schema: Any, timeout: float | None = None, on_error: str = "raise") -> DataFrame:
    """A coroutine for each row, all of a batch together. A row that fails or is late fails the task, or alone is
    dropped with ``on_error='drop'``; its batch is not lost."""

    def run_all(rows: list[dict]) -> list[Any]:
        async def every():
            return await asyncio.gather(*(asyncio.wait_for(f(r), timeout) for r in rows), return_exceptions=True)

        return asyncio.run(every())

    return _per_row(df, schema, on_error, run_all)


def parallel_map(df: DataFrame, f: Callable[[dict], dict], schema: Any, threads: int = 8, on_error: str = "raise") -> DataFrame:
    """A function for each row, run by a pool of threads; failures as in async_map."""

    def run_all(rows: list[dict]) -> list[Any]:
        def safe(r: dict) -> Any:
            try:
                return f(r)
            except Exception as e:
                return e

        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(safe, rows))

    return _per_row(df, schema, on_error, run_all)


def async_mapi(df: DataFrame, f, schema: Any, **more: Any) -> DataFrame:
    """As async_map; f's row also has part and idx."""
    return async_map(mapi(df), f, schema, **more)


def parallel_mapi(df: DataFrame, f, schema: Any, **more: Any) -> DataFrame:
    return parallel_map(mapi(df), f, schema, **more)


def filter_by_key(df: DataFrame, pred: Expr) -> DataFrame:
    """A filter that reads key columns only; pushed to the scan like any other."""
    return df.where(col(pred))


def map_by_value(df: DataFrame, keys: list[str], **values: Expr) -> DataFrame:
    return df.select(*keys, *named(values))


def async_map_by_value(df: DataFrame, keys: list[str], f, schema: Any, **more: Any) -> DataFrame:
    """f maps the values of a row; the schema is of keys and new values."""

    async def keyed(r: dict) -> dict:
        return {k: r[k] for k in keys} | await f({k: v for k, v in r.items() if k not in keys})

    return async_map(df, keyed, schema, **more)


def parallel_map_by_value(df: DataFrame, keys: list[str], f, schema: Any, **more: Any) -> DataFrame:
    def keyed(r: dict) -> dict:
        return {k: r[k] for k in keys} | f({k: v for k, v in r.items() if k not in keys})

    return parallel_map(df, keyed, schema, **more)
