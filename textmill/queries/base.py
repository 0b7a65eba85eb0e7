"""The register of queries, and what many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import words
from textmill.sources.readers import Source, descriptors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The configuration that stands in for a corpus: sources src0 ... src19 by number modulo 4.
CATEGORIES = ("python_code", "other_code", "technical_english", "english_replay")
MIX = {"python_code": 0.5, "other_code": 0.2, "technical_english": 0.2, "english_replay": 0.1}
SHARD_TOKENS = 200_000
SOURCES = tuple(Source(f"src{i}", CATEGORIES[i % 4], 1.0 if i % 8 < 4 else 0.5, languages=("en", "de") if i % 4 == 0 else (("en", "fr") if i % 4 == 1 else ())) for i in range(20))


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category(source: Column) -> Column:
    n = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    return F.get(F.array(*(F.lit(c) for c in CATEGORIES)), n % 4)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, seq, category, lang, text, n_chars."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("source_id"), F.col("doc_id").alias("seq"), category(F.col("source")).alias("category"), "lang", "text", F.length("text").alias("chars"))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the number of their words as tokens; the text itself is left behind."""
    return docs(spark, sf_dir).select("source_id", "seq", "category", F.size(words("text")).cast("long").alias("n_tokens"))


def sources(spark: SparkSession) -> DataFrame:
    return descriptors(spark, SOURCES)


def mix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MIX.items()), "category string, fraction double")


#: SQL for the same.
SQL_CATEGORY = "CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'python_code' WHEN 1 THEN 'other_code' WHEN 2 THEN 'technical_english' ELSE 'english_replay' END"
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL_DOCS = f"docs AS (SELECT source AS source_id, doc_id AS seq, {SQL_CATEGORY} AS category, lang, text, CAST(len({SQL_WORDS}) AS BIGINT) AS n_tokens FROM documents)"
SQL_TARGETS = (
    "config AS (SELECT 'src' || i AS source_id, list_value('python_code','other_code','technical_english','english_replay')[i % 4 + 1] AS category, CASE WHEN i % 8 < 4 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM range(20) t(i)),"
    f" mix AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in MIX.items())}) t(category, fraction)),"
    f" targets AS (SELECT source_id, category, CAST(floor(floor({SHARD_TOKENS} * fraction) * weight / sum(weight) OVER (PARTITION BY category)) AS BIGINT) AS target FROM config JOIN mix USING (category))"
)
SQL_TAKEN = "taken AS (SELECT d.*, t.target, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY d.source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM docs d JOIN targets t USING (source_id) QUALIFY before < target)"


def sql_uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('#', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
