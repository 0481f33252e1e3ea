"""The corpus queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_tree, conversation_repair, embedding_dedup, exact_dedup, language, line_templates, packing, piece_lattice, quality, sharding, simhash, spelling_variants, token_trees
from .oracles import ORACLE_SQL as ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.encode_digest(_documents(spark, sf_dir), piece_lattice.load(piece_lattice.default_model()))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_manifest(_documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trees.count_and_edit(_documents(spark, sf_dir), token_trees.default_vocabulary())


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(_documents(spark, sf_dir), exact_texts=line_templates.EXACT_TEXTS)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), packing.default_tokenizer())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, there = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair_report(rows, there=there)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_documents(spark, sf_dir), damage=True)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {
    "op1_pieces": op1_pieces,
    "op2_sharding": op2_sharding,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_context_tree": op5_context_tree,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_line_templates": op8_line_templates,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_dedup": op13_embedding_dedup,
}
