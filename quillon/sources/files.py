"""Files as datasets: folders of bytes, numbered lines, sparse examples, and Spark's own formats."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON, text or JDBC by Spark's readers."""
    r = spark.read.format(form).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def folder(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content) of files, path being relative to the folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)
    base = path.rstrip("/") + "/"
    return df.select(F.element_at(F.split("path", F.lit("\\Q" + base.split("://", 1)[-1].removeprefix("file:") + "\\E"), 2), -1).alias("path"), "content")


def lines(spark: SparkSession, path: str, totals: bool = False) -> DataFrame:
    """(file, line, content), lines from 1; with ``totals`` a last row (file, lines, null) for each file.

    Files are read in splits: lines are numbered inside each, and moved up by the lines of the splits before, of which
    there is a row each. A file of any size is read by many tasks. Empty files give no line and no total.
    """
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    read = spark.read.text(path).select(at.alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("content"))
    splits = read.groupBy("at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("at.path").orderBy("at.start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = read.join(splits, "at").select(F.col("at.file").alias("file"), (F.col("id") - F.col("first") + F.col("base") + 1).alias("line"), "content")
    if totals:
        out = out.unionByName(splits.groupBy("at").agg(F.sum("n").alias("n")).groupBy("at.path", "at.file").agg(F.sum("n").alias("line")).select("file", "line", F.lit(None).cast("string").alias("content")))
    return out


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "line") -> DataFrame:
    """Line numbers of rows that have an order already."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def sparse_examples(spark: SparkSession, path: str) -> DataFrame:
    """(label, indices, vals) of text lines 'label index:value ...'; splits of a file are read in parallel."""
    parts = F.filter(F.split(F.trim("value"), "\\s+"), lambda s: s != "")
    pairs = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return spark.read.text(path).where(F.trim("value") != "").select(
        F.get(parts, F.lit(0)).cast("float").alias("label"),
        F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(1)).cast("int")).alias("indices"),
        F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(2)).cast("float")).alias("vals"),
    )


def retrieve_folder(df: DataFrame, path: str) -> None:
    """Write rows (path, content) as files below a folder that all nodes share."""

    def run(rows) -> None:
        for r in rows:
            to = os.path.normpath(os.path.join(path, r.path))
            if not to.startswith(os.path.normpath(path) + os.sep):
                raise ValueError(f"{r.path} leads out of the folder")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to + ".part", "wb") as f:
                f.write(r.content)
            os.replace(to + ".part", to)  # a task that runs twice leaves the same file

    df.select("path", "content").foreachPartition(run)
