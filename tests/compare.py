"""Queries against their SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows(columns, data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in data)


def by_duckdb(sql: str, sf_dir: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return sorted(columns), rows(columns, got.fetchall())


def by_spark(df) -> tuple[list[str], list[str]]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
