"""A corpus from documents to packed sequences, in five stages.

Each stage takes what the one before kept, as a table written and read again. Documents without a told language go; one
document of each class of near duplicates (5-word shingles, similarity 0.8 or more) stays; passages that an earlier
document has are cut; documents with a passage of the benchmark go; the rest is encoded and packed. All stages but the
last return the columns of documents, extra ones too. Null doc_ids, null and empty texts, repeated rows and empty tables
are as the stages' operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.decontam import decontaminate
from quillon.llm.langid import language_filter
from quillon.llm.neardup import near_duplicates_dropped
from quillon.llm.packing import pack
from quillon.llm.suffixdedup import suffix_dedup
from quillon.runtime import cut, remove, shared_path, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates_dropped(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", passage_dedup), ("benchmark decontamination", benchmark_filter), ("best-fit packing", packing)]

#: The stages use hashes, models and tokenizers that SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, before)
    return out
