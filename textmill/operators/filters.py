"""Predicates that decide which documents a source contributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import col, extension_language, normal_language, strip

#: The stop words and categories of the acceptance rules.
STOP_WORDS = "the and that with for this from are you not have can will use using when where what why how".split()
CODE_CATEGORIES = ("python_code", "other_code")
ENGLISH_CATEGORIES = ("technical_english", "english_replay")
SAMPLE_CHARS, SAMPLE_WORDS = 5000, 400


def looks_english(text: Column | str, *, min_ascii: float = 0.85, min_hits: int = 2) -> Column:
    """Judges the first 5000 characters: mostly ASCII, and stop words among the first 400 words of letters."""
    sample = F.substring(col(text), 1, SAMPLE_CHARS)
    ascii_ = F.length(F.regexp_replace(sample, r"[^\x00-\x7F]", "")) / F.greatest(F.length(sample), F.lit(1))
    found = F.slice(F.regexp_extract_all(F.lower(sample), F.lit("[a-z]{2,}"), F.lit(0)), 1, SAMPLE_WORDS)
    hits = F.size(F.filter(found, lambda w: w.isin(*STOP_WORDS)))
    return F.coalesce((strip(sample) != "") & (ascii_ >= min_ascii) & (hits >= min_hits), F.lit(False))


def language_matches(languages: Column, *candidates: Column, path: Column | None = None) -> Column:
    """Whether any candidate, or what the path's extension stands for, is among a source's languages; without languages, always."""
    named = F.array(*(normal_language(c) for c in candidates), F.coalesce(extension_language(path), F.lit("")) if path is not None else F.lit(""))
    wanted = F.transform(languages, normal_language)
    return F.coalesce(F.size(languages) <= 0, F.lit(True)) | F.arrays_overlap(F.filter(named, lambda x: x != ""), wanted)


def keep_document(text: Column | str, category: Column | str, *, min_chars: int = 32, language_ok: Column | None = None, english_only: Column | None = None, chunk_type: Column | None = None, min_chunk_chars: int | None = None) -> Column:
    """Long enough; code in a wanted language; English where the category is English.  Cheap tests come first."""
    text, category = col(text), col(category)
    least = F.lit(min_chars)
    if chunk_type is not None and min_chunk_chars is not None:
        least = F.when(chunk_type.isNotNull() & (category == "python_code"), min_chunk_chars).otherwise(min_chars)
    long_enough = F.length(F.coalesce(text, F.lit(""))) >= least
    code = category.isin(*CODE_CATEGORIES)
    english = category.isin(*ENGLISH_CATEGORIES) | F.coalesce(english_only if english_only is not None else F.lit(False), F.lit(False))
    return F.when(~long_enough, False).when(code & ~(language_ok if language_ok is not None else F.lit(True)), False).when(english, looks_english(text)).otherwise(True)


def is_python(category: Column, path: Column, *languages: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    by_path = low.endswith(".py") | low.endswith(".pyi") | low.endswith(".ipynb")
    named = F.lit(False)
    for x in languages:
        named = named | normal_language(x).contains("python")
    return F.coalesce((category == "python_code") & (by_path | named), F.lit(False))


def not_generated(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce("is_vendor", F.lit(False)) & ~F.coalesce("is_generated", F.lit(False)))


def needs_execution(task: Column | str) -> Column:
    return F.lower(col(task)).rlike(r"^(humaneval|humanevalplus|mbpp|mbppplus|apps|ds1000|multiple)(-|$)")


def scalars(json_text: Column | str) -> Column:
    """The scalar items of a JSON object, nulls too, as a map in key order; what is scalar is told by its JSON type."""
    items = F.map_entries(F.try_variant_get(F.try_parse_json(col(json_text)), "$", "map<string,variant>"))
    plain = F.filter(items, lambda e: ~F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID")).rlike("^(ARRAY|OBJECT)"))
    return F.map_from_entries(F.array_sort(F.transform(plain, lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))))
