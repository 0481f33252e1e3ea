"""Documents to packed sequences: quality, language, line dedup, near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import language, line_templates, near_copies, packing, quality
from barloom.llm.common import small_batches, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is found with confidence go."""
    small_batches(spark)
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across texts go from all but their first document."""
    small_batches(spark)
    return line_templates.drop_lines(docs, exact_texts=line_templates.EXACT_TEXTS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity 0.8) stays."""
    small_batches(spark)
    return near_copies.drop_near_copies(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality", quality_rules),
    ("language", language_id),
    ("lines", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", best_fit),
]

#: A classifier and a tokenizer are beyond SQL; the pipeline is tested against its brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each over the table that the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
