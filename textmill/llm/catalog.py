"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import sql
from textmill.llm.alignment import alignment_digest
from textmill.llm.bpe_trie import bpe_digest
from textmill.llm.bytenet import quality_scores
from textmill.llm.common import table
from textmill.llm.divergence import quality_rules
from textmill.llm.forest import near_components
from textmill.llm.html_text import html_main_text
from textmill.llm.language import language_id
from textmill.llm.mixing import mix
from textmill.llm.packing import pack_documents
from textmill.llm.passages import passage_digest
from textmill.llm.projections import near_vectors
from textmill.llm.token_files import token_digest
from textmill.llm.whitening import whiten


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))


def op3_composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main_text(table(spark, sf_dir, "pages"))


def op4_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_column_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digest(table(spark, sf_dir, "documents"))


def op7_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def op12_label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(table(spark, sf_dir, "documents"))


def op13_block_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_token_files, op3_composite_density, op4_byte_convolution, op5_vector_packing, op6_column_transform, op7_bitmask_language, op8_divergence_rules, op9_sorted_projections, op10_lsh_forest, op11_prefix_trie, op12_label_spans, op13_block_lanczos)}


def oracle_sql() -> dict[str, str]:
    return {"op6_column_transform": sql.OP6, "op8_divergence_rules": sql.OP8, "op9_sorted_projections": sql.OP9, "op10_lsh_forest": sql.OP10}
