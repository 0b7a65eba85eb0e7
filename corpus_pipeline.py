"""A corpus pipeline of five stages: language, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet in the shared folder and reads it again as the next stage's input.  All stages but the last
return the columns of their input.  What a stage decides takes effect: rows that it rejects are gone,
texts that it cuts are cut, documents that the mixture repeats are there as often.

Null texts go at the first stage; null ids are ids like others at every stage.  Rows that repeat whole
are a group of near-duplicates, of which one stays.  Of a group any one may stay, the same one on every
run over the same files.  An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import saved, table
from textmill.llm.forest import Settings as Near
from textmill.llm.forest import without_near_duplicates
from textmill.llm.language import identify, learn
from textmill.llm.mixing import mixed
from textmill.llm.packing import pack_documents
from textmill.llm.passages import without_repeats

#: A text fewer of whose n-grams are known in any language is in none of them.
LEAST_COVERAGE = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null texts, and texts hardly any of whose n-grams a learned language has."""
    return identify(docs, learn(docs), least_coverage=LEAST_COVERAGE).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, 0.8), whatever its id."""
    return without_near_duplicates(docs, settings=Near(words=5, percent=80)).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; documents that consist of them alone go."""
    cut = without_repeats(docs).filter(F.col("text").isNull() | (F.length("text") > 0))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # executors hold what earlier stages left, so workers have smaller caches here
    return pack_documents(docs, cache_pieces=150_000, batch_bytes=1 << 20)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("mixture", mixture),
    ("packing", packing),
]

#: No SQL expresses models, flow or packing; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
