"""Partitions, batches and caches. None of these changes the rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.position import overall
from quillon.operators.transforms import Expr, col, map_batches, unused

#: Largest estimate of a plan's bytes for which a side is broadcast; beyond it Spark chooses another way.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a plan's output, from file sizes and column widths."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def multicast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a dataset for every node, if its estimate is within the limit; read by itself it has its rows once."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def repartition_by(df: DataFrame, n: int, to: Expr) -> DataFrame:
    """Send each row to partition pmod(to, n)."""
    return df.repartitionById(n, F.pmod(col(to), F.lit(n)).cast("int"))


def repartition(df: DataFrame, to: Expr) -> DataFrame:
    return repartition_by(df, df.rdd.getNumPartitions(), to)


def repartition_by_key(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def repartition_by_unique_key(df: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """A partition for each distinct key, in order of the keys, nulls last.

    More than ``most`` keys share that many partitions: key number k in order goes to partition k % most, so a key is
    still in one partition. Keys are numbered without bringing them to the driver.
    """
    to, at = unused("_to", df), unused("_key", df)
    keys = df.select(F.col(key).alias(at)).distinct()
    place = overall(keys, F.col(at).asc_nulls_last(), name=to)
    n = place.count()
    if not n:
        return df
    place = place.withColumn(to, (F.col(to) % most).cast("int"))
    joined = df.join(F.broadcast(place) if n <= most else place, df[key].eqNullSafe(place[at])).drop(at)  # most rows at most
    return joined.repartitionById(min(n, most), F.col(to)).drop(to)


def rows_reorg(df: DataFrame, n: int) -> DataFrame:
    """Batches of n rows for the Python operators above (0: whole partitions)."""
    return map_batches(df, lambda t: t, df.schema, rows=n)


def rows_split(df: DataFrame) -> DataFrame:
    return rows_reorg(df, 1)


def rows_merge_all(df: DataFrame) -> DataFrame:
    return rows_reorg(df, 0)


def reorg_with_degree(df: DataFrame, k: int) -> DataFrame:
    """k parallel jobs over the rows."""
    return df.repartition(k)


def cache_in_memory(df: DataFrame) -> DataFrame:
    """A hint: lazy, spilling to disk, recomputed if lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def cache_on_disk(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.DISK_ONLY)


def salted(df: DataFrame, key: Column | str, salts: int) -> DataFrame:
    """Add a column ``salt`` that spreads each key over ``salts`` tasks."""
    return df.withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
