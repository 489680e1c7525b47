"""Named, versioned datasets in Parquet, deferred and monitored saves, and a key-value store."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillon.operators.transforms import Expr, col


class Store:
    """Datasets below a root folder as root/name/version; a version is complete once Spark has marked it so."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._later: list[tuple[DataFrame, str]] = []

    def _list(self, pattern: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}/*/_SUCCESS")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return sorted(str(f.getPath().getParent()) for f in found or [])

    def save(self, df: DataFrame, name: str, version: int | None = None, partition_by: list[str] | None = None) -> str:
        """Write at once; the version is the time unless given."""
        path = f"{self.root}/{name}/{time.time_ns() if version is None else version:020d}"
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        return path

    def store(self, rows, schema, name: str, version: int | None = None, partitions: int | None = None, cancelled: Callable[[], bool] | None = None) -> str | None:
        """Rows of the client, dealt evenly; nothing is kept if ``cancelled`` says so before the end."""
        rows = list(rows)
        if cancelled and cancelled():
            return None
        df = self.spark.createDataFrame(rows, schema)
        return self.save(df.repartition(partitions) if partitions else df, name, version)

    def lazy_save(self, df: DataFrame, name: str) -> DataFrame:
        """Written when the next action through this store runs; df is kept so that both use one computation."""
        df.persist()
        self._later.append((df, name))
        return df

    def flush(self) -> list[str]:
        done = [self.save(d, n) for d, n in self._later]
        for d, _ in self._later:
            d.unpersist()
        self._later.clear()
        return done

    def run(self, action: Callable[[], object]) -> object:
        """An action of a sibling branch, then the saves that wait."""
        got = action()
        self.flush()
        return got

    def save_with_monitor(self, df: DataFrame, name: str, pred: Expr) -> Iterator[Row]:
        """Write, and give the rows that meet a predicate, from what was written."""
        path = self.save(df, name)
        return self.spark.read.parquet(path).where(col(pred)).toLocalIterator()

    def path(self, name: str, version: int | None = None) -> str:
        found = [p for p in self._list(name) if version is None or p.endswith(f"/{version:020d}")]
        if not found:
            raise FileNotFoundError(f"no dataset {name}" + ("" if version is None else f" of version {version}"))
        return found[-1]

    def load(self, name: str, version: int | None = None) -> DataFrame:
        """The newest version, or the one given."""
        return self.spark.read.parquet(self.path(name, version))

    def try_find(self, pattern: str) -> list[tuple[str, DataFrame]]:
        """(name, newest version) of all datasets whose name meets a wildcard."""
        newest = {p.rsplit("/", 2)[1]: p for p in self._list(pattern)}
        return [(n, self.spark.read.parquet(p)) for n, p in sorted(newest.items())]

    def length(self, name: str, version: int | None = None) -> int:
        """Rows; Parquet answers from its footers."""
        return self.spark.read.parquet(self.path(name, version)).count()

    def size_in_bytes(self, name: str, version: int | None = None) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name, version))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


class KVStore:
    """A keyed table of deltas: later puts win, updates merge by a Column aggregate, keys may fold case."""

    def __init__(self, store: Store, name: str, value_type: str, default=None, ignore_case: bool = False, merge: Callable[[Column], Column] = F.sum):
        self.store, self.name, self.default, self.merge, self.ignore_case = store, name, default, merge, ignore_case
        self.schema = f"k string, v {value_type}, seq long, put boolean"

    def _append(self, rows, put: bool) -> None:
        seq = time.time_ns()
        self.store.save(self.store.spark.createDataFrame([(k, v, seq + i, put) for i, (k, v) in enumerate(rows)], self.schema), self.name)

    def put(self, *rows: tuple) -> None:
        self._append(rows, True)

    def update(self, *rows: tuple) -> None:
        self._append(rows, False)

    def clear(self) -> None:
        self.store.save(self.store.spark.createDataFrame([], self.schema), self.name, 1)
        for p in self.store._list(self.name):
            if not p.endswith(f"/{1:020d}"):
                q = self.store.spark._jvm.org.apache.hadoop.fs.Path(p)
                q.getFileSystem(self.store.spark._jsc.hadoopConfiguration()).delete(q, True)

    def snapshot(self) -> DataFrame:
        """(k, v): the newest put of a key merged with the updates after it."""
        parts = self.store._list(self.name)
        all_ = self.store.spark.read.schema(self.schema).parquet(*parts) if parts else self.store.spark.createDataFrame([], self.schema)
        return merge_deltas(all_.withColumn("k", F.lower("k")) if self.ignore_case else all_, self.merge)

    def get(self, key: str):
        got = self.snapshot().where(F.col("k") == (key.lower() if self.ignore_case else key)).first()
        return self.default if got is None else got.v


def merge_deltas(deltas: DataFrame, merge: Callable[[Column], Column] = F.sum) -> DataFrame:
    """(k, v) of rows (k, v, seq, put): the last put of each key and the updates after it, merged."""
    last = deltas.groupBy("k").agg(F.max(F.when(F.col("put"), F.col("seq"))).alias("_from"))
    live = deltas.join(last, "k").where("_from is null or seq >= _from")
    return live.groupBy("k").agg(merge(F.col("v")).alias("v"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
