"""Language identification with one Bloom filter for all languages.

The filter is a table of rows, each a bitmask with one bit per language.  Adding an n-gram sets the
language's bit in the rows that its hashes name; a lookup takes the bitwise AND of those rows and so
returns all languages that contain the n-gram at once.  A language's hits in a text are a population
count over the text's n-grams.  The filter's own share of set bits tells how often a language is
returned by chance; hits are corrected for that before they decide.

N-grams are of bytes of the lower-cased text, at every place of the whole text.  The model is fitted
on a bounded sample of every language that has a learnable row: about `sample_docs` texts, chosen by
hash, with many languages fewer (`sample_total` over all, but `sample_least` each); of a longer text
it learns from the first `sample_chars` characters.

Null text, or text without a letter: `und`, score 0.  Without any language all texts are `und`.  Ties go
to the first language by code point.  Very long texts are looked up in parts; repeated rows have equal
results and count once in the sample.  Empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from textmill.llm.common import arrow, claim, learnable, text_of

#: Odd multipliers for the hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LETTER = re.compile(r"[^\W\d_]")  # and some numerals
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (3, 5)
    row_bits: int = 20
    hashes: int = 3
    sample_docs: int = 300
    sample_total: int = 30_000
    sample_least: int = 10
    sample_chars: int = 50_000
    least_count: int = 2
    least_ratio: float = 0.2  # of the n-gram's highest frequency in any language; less is foreign matter


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Each n-gram of bytes as an integer (n up to 8)."""
    count = max(0, len(data) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out |= data[k : k + count].astype(np.uint64) << np.uint64(8 * k)
    return out


def rows_of(keys: np.ndarray, row_bits: int, hashes: int):
    with np.errstate(over="ignore"):
        for m in MULTIPLIERS[:hashes]:
            x = keys * np.uint64(m)
            yield (x ^ (x >> np.uint64(29))) * np.uint64(m) >> np.uint64(64 - row_bits)


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    tables: dict[int, np.ndarray]  # by n-gram size: rows x words of 64 languages
    chance: dict[int, np.ndarray]  # by n-gram size and language: how often a lookup returns it by chance


def fit(samples: dict[str, list[str]], settings: Settings = Settings()) -> Model:
    languages = sorted(samples)
    words = max(1, -(-len(languages) // 64))
    tables, chance = {}, {}
    for n in settings.sizes:
        table = np.zeros((1 << settings.row_bits, words), np.uint64)
        own = []
        for name in languages:
            data = np.frombuffer("\n".join(samples[name]).lower().encode("utf-8", "replace"), np.uint8)
            keys, counts = np.unique(grams(data, n), return_counts=True)
            own.append((keys, counts, counts / max(1, len(data))))
        every, where = np.unique(np.concatenate([x[0] for x in own]) if own else np.zeros(0, np.uint64), return_inverse=True)
        most = np.zeros(len(every))
        np.maximum.at(most, where, np.concatenate([x[2] for x in own]) if own else np.zeros(0))
        for i, (keys, counts, share) in enumerate(own):
            typical = (counts >= settings.least_count) & (share >= settings.least_ratio * most[np.searchsorted(every, keys)])
            for rows in rows_of(keys[typical], settings.row_bits, settings.hashes):
                np.bitwise_or.at(table[:, i // 64], rows, np.uint64(1 << (i % 64)))
        fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        tables[n], chance[n] = table, fill**settings.hashes
    return Model(settings, languages, tables, chance)


#: Bytes looked up at once; longer texts are taken in overlapping parts.
PART = 1 << 18


def hits(model: Model, data: np.ndarray) -> tuple[np.ndarray, int]:
    """Corrected population counts by language, and the number of n-grams."""
    total, places = np.zeros(len(model.languages)), 0
    s = model.settings
    for n in s.sizes:
        seen, count = np.zeros(len(model.languages)), 0
        for at in range(0, max(0, len(data) - n + 1), PART):
            keys = grams(data[at : at + PART + n - 1], n)
            found = None
            for rows in rows_of(keys, s.row_bits, s.hashes):
                own = model.tables[n][rows]
                found = own if found is None else found & own
            for i in range(len(model.languages)):
                seen[i] += int(np.count_nonzero(found[:, i // 64] & np.uint64(1 << (i % 64))))
            count += len(keys)
        total += np.maximum(0.0, (seen - count * model.chance[n]) / (1 - np.minimum(model.chance[n], 0.99)))
        places += count
    return total, places


def predict(model: Model, text: str | None) -> tuple[str, float, float]:
    """Language, its share of all languages' hits, and the share of n-grams that it contains."""
    if not text or not model.languages or not any(m[0].isalpha() for m in _LETTER.finditer(text)):
        return UNKNOWN, 0.0, 0.0
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if len(data) < max(model.settings.sizes):
        data = np.concatenate([[32], data, [32] * max(model.settings.sizes)]).astype(np.uint8)
    total, places = hits(model, data)
    if total.sum() <= 0:
        return model.languages[0], 0.0, 0.0
    best = int(np.argmax(total))
    return model.languages[best], float(min(1.0, total[best] / total.sum())), float(min(1.0, total[best] / max(1, places)))


def learn(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", settings: Settings = Settings()) -> Model:
    """Fits on learnable rows: a hash of id and text below a language's own threshold chooses its sample; only the sample's texts move."""
    rows = df.filter(learnable(id_column) & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    rows = rows.select(F.col(lang_column).cast("string").alias("_lang"), text_of(text_column).alias("_text"), F.xxhash64(F.col(id_column), text_of(text_column)).alias("_h"))
    known = rows.groupBy("_lang").count().collect()  # a row for each language
    each = min(settings.sample_docs, max(settings.sample_least, settings.sample_total // max(1, len(known))))
    limits = df.sparkSession.createDataFrame([(r["_lang"], max(1.0, each / r["count"] * (1 << 30))) for r in known], "_lang string, _limit double")
    picked = rows.join(F.broadcast(limits), "_lang").filter(F.pmod("_h", F.lit(1 << 30)) < F.col("_limit"))
    samples: dict[str, list[str]] = {r["_lang"]: [] for r in known}
    # rows that repeat have one hash, and are one text of the sample
    for r in picked.groupBy("_lang", "_h").agg(F.first(F.substring("_text", 1, settings.sample_chars)).alias("_text")).collect():
        samples[r["_lang"]].append(r["_text"])
    few = [x for x, texts in samples.items() if len(texts) < settings.sample_least]
    if few:  # a small language's own rows decide; the draw may have taken too few of them
        samples |= {x: [] for x in few}
        own = rows.filter(F.col("_lang").isin(few)).dropDuplicates(["_lang", "_h"]).withColumn("_r", F.row_number().over(W.partitionBy("_lang").orderBy("_h"))).filter(F.col("_r") <= settings.sample_least)
        for r in own.select("_lang", F.substring("_text", 1, settings.sample_chars).alias("_text")).collect():
            samples[r["_lang"]].append(r["_text"])
    for texts in samples.values():
        texts.sort()
    return fit(samples, settings)


#: Columns that `identify` adds; where a table has them, with one more underscore.
ADDED = (("_lang_pred", T.StringType()), ("_score", T.DoubleType()), ("_coverage", T.DoubleType()))


def _added(taken: list[str]) -> list[T.StructField]:
    out = []
    for name, kind in ADDED:
        while name in taken:
            name = f"_{name}"
        out.append(T.StructField(name, kind))
    return out


def identify(df: DataFrame, model: Model, text_column: str = "text", *, keep_text: bool = True, least_coverage: float | None = None) -> DataFrame:
    """df with _lang_pred, _score and _coverage (and without its text column, if that isn't to be kept).

    With least_coverage, rows of an unknown language or of less coverage are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    at = names.index(text_column)
    kept = [i for i in range(len(names)) if keep_text or i != at]
    schema = T.StructType([df.schema.fields[i] for i in kept] + _added(names))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language", lambda: vars(shared).pop("_value", None))  # the model, which this process can read again
        for part in parts:
            found = [predict(shared.value, x.as_py()) for x in part.column(at)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            out = pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *columns], names=schema.names)
            if least_coverage is not None:
                out = out.filter(pa.array([f[0] != UNKNOWN and f[2] >= least_coverage for f in found], pa.bool_()))
            yield out

    return arrow(df, run, schema)


def language_id(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", settings: Settings = Settings()) -> DataFrame:
    model = learn(df, id_column=id_column, text_column=text_column, lang_column=lang_column, settings=settings)
    docs = df.select(F.col(id_column).alias("doc_id"), (~learnable(id_column)).alias("held_out"), F.col(text_column).cast("string").alias("_text"))
    out = identify(docs, model, "_text", keep_text=False)
    return out.select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_coverage").alias("coverage"))
