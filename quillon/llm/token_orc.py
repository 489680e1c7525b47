"""Token ids in ORC: integer run lengths, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id, encoded, and written in ascending order of doc_id, one file for a range. Each
row has the number of its range and its own number there, so a reader finds the place of a document from the ranges' sums
and its own file. Lookups by doc_id skip files, stripes and row groups by their minima, maxima and Bloom filters.

Null and empty texts have one token, the end id. Rows with the same doc_id stay together in the order in which they are
written, and null doc_ids come first. Extra columns of any name are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.tokens import END_ID, Encoder, default_vocabulary
from quillon.runtime import cut, remove, shared_path, ship, table

#: Rows of a row group, which has its own minima, maxima and Bloom filter; the format's least number.
STRIDE = 1000
SCHEMA = "range int, row long, doc_id long, n_tokens int, ids array<int>"


def _encoder(path: str | None):
    def run(batches):
        enc = Encoder.of(path or default_vocabulary())
        end, row = END_ID.to_bytes(4, "little"), 0
        for b in batches:
            docs = b.column(0)
            for at in range(0, b.num_rows, 256):
                ids = [x + end for x in enc.encode(b.column(1).slice(at, 256).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), docs.slice(at, 256), pa.array(n), lists], names=["row", "doc_id", "n_tokens", "ids"])
                row += len(n)

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write (range, row, doc_id, n_tokens, ids) as ORC files in ascending doc_id order."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = placed.mapInArrow(_encoder(vocabulary), "row long, doc_id long, n_tokens int, ids array<int>")
    out = ids.select(F.spark_partition_id().alias("range"), "row", "doc_id", "n_tokens", "ids").write
    out.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", STRIDE).orc(path)


def _digest(batches):
    for b in batches:
        ids = b.column("ids")
        off, data = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("range"), b.column("row"), b.column("doc_id"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], names=["range", "row", "doc_id", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all from the files as they are read back."""
    ship(spark)
    rows = cut(spark.read.schema(SCHEMA).orc(path).select("range", "row", "doc_id", "ids").mapInArrow(_digest, "range int, row long, doc_id long, n_tokens long, ids_crc32 long"))
    sums = rows.groupBy("range").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    starts = sums.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = Window.partitionBy("range").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn("upto", F.sum("n_tokens").over(own)).join(starts, "range")
    return told.select("doc_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The rows of one document; the scan's pushed filter prunes by footers, indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id") == doc_id)


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    out = read_index(spark, path)
    remove(spark, path)
    return out


QUERIES = {"op5_token_orc": op5_token_orc}
ORACLE: dict[str, str] = {}
