"""A corpus pipeline: quality rules, near duplicates, secrets, packing. Each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from karyoframe.llm.common import scratch_path, table
from karyoframe.llm.jaccard import without_near_copies
from karyoframe.llm.packing import pack
from karyoframe.llm.quality import keep_good
from karyoframe.llm.secrets import without_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar texts: 5-word shingles, 80 % in common. Other rows all stay."""
    return without_near_copies(docs, 5, 80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' byte-level tokens into sequences of permitted lengths."""
    return pack(docs)


STAGES = [("quality rules", quality), ("n-gram jaccard join", near_duplicates), ("secret scans", secrets), ("best-fit packing", packing)]

#: SQL cannot express learned rules, forests or best fit; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
