"""The corpus pipeline: documents in, packed training sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next stage. All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sketchloom.llm.common import materialize
from sketchloom.llm.decontamination import drop_contaminated
from sketchloom.llm.lines import dedup_lines
from sketchloom.llm.packing import best_fit_packing, word_counts
from sketchloom.llm.quality import keep_quality
from sketchloom.llm.simhash import keep_first_of_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come, equal or similar, earlier in the corpus."""
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id."""
    return keep_first_of_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences, by words."""
    return best_fit_packing(word_counts(docs))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packing),
]

#: Isolation forests, MinHash bands and best-fit packing have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Null and empty texts fail the quality rules; a text that loses all its lines is packed as
    one row without a bin; null items and labels decide nothing; rows without a doc_id pass the stages that go by id;
    repeated rows are judged alike; further columns pass through until packing; empty tables give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
