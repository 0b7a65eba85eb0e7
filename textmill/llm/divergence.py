"""Quality rules by distribution divergence, in DataFrame functions only.

A language's reference is a pair of histograms over all its documents: classes of characters in words,
and its most common words with one bin for all other words.  A document is compared with the reference of
its `lang` by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1), and fails
if either distance is over its threshold.  Guards: a histogram of fewer characters or words than the
minimum isn't judged, and a language with fewer documents than the minimum, or none, has the pooled
reference of all documents.

No document moves: references are one small row per language, computed by aggregates that are
combined before the shuffle; the second pass is a projection after a join with those rows.

Null text: empty text, no words, base_failed.  Very long texts: whole, in time linear in them.  Words that
tie for the last common place are taken in alphabetical order; a distance equal to its threshold passes.  Null or rare `lang`: pooled reference.  Repeated rows
and null ids: a result each.  Empty table: empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.llm.common import saved, text_of, words_of

SPACE = r"\x20\x09-\x0D"
#: Character classes, stripped one after the other; what is left is the last bin.
#: The second is white space, and what it leaves are the characters in words.  The last are the symbols
#: of the base rules, none of which is in a class before it.
CLASSES = (r"\p{Ll}+", rf"[{SPACE}]+", r"\p{Lu}+", r"[.,;:!?'\"()-]+", r"\p{L}+", r"\p{N}+", r"[#*$%&|<>]+")
SYMBOLS = "#*$%&|<>"
SHINGLE = 5


@dataclass(frozen=True)
class Rules:
    common_words: int = 16
    min_docs: int = 20
    min_chars: int = 100
    min_words: int = 50
    max_class_distance: float = 0.3
    max_word_distance: float = 0.42
    min_words_base: int = 10
    max_repeat_percent: int = 20


def class_counts(text: Column) -> Column:
    """Code points of each class, as an array of longs; each class is taken from what the ones before left."""
    lengths, rest = [F.length(text)], text
    for pattern in CLASSES:
        rest = F.regexp_replace(rest, pattern, "")
        lengths.append(F.length(rest))
    bins = [a - b for a, b in zip(lengths, lengths[1:], strict=False)] + [lengths[-1]]
    return F.array(*(b.cast("long") for b in bins))


def repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 5-word windows that occur twice or more in the same row's `_words`.

    Windows are compared as 64-bit hashes, put together from hashes of words and of pairs of words.  A window that
    occurs again repeats four pairs, so texts with fewer repeated pairs have no windows hashed, and only texts in
    which two windows agree are looked at by position.
    """
    def joined(a: str, b: str, by: int) -> Column:
        return F.zip_with(F.col(a), F.slice(b, by + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))

    df = df.withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_pairs", joined("_w", "_w", 1))
    again = F.size("_pairs") - F.size(F.array_distinct("_pairs")) >= SHINGLE - 1
    windows = F.zip_with(joined("_pairs", "_pairs", 2), F.slice("_w", SHINGLE, F.size("_w")), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn("_h", F.when(again, F.slice(windows, 1, F.greatest(F.size("_words") - (SHINGLE - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    before = lambda i: F.when(i > 0, F.get("_sorted", i - 1)["h"])
    twins = F.filter("_sorted", lambda x, i: x["h"].eqNullSafe(F.get("_sorted", i + 1)["h"]) | x["h"].eqNullSafe(before(i)))
    df = df.withColumn("_at", F.sort_array(F.transform(twins, lambda x: x["p"])))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(SHINGLE), F.coalesce(F.get("_at", i + 1) - p, F.lit(SHINGLE)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", covered.cast("long"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    def half(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda x, y: x + y) / 2, F.lit(0.0)))


def references(df: DataFrame, rules: Rules) -> DataFrame:
    """One row per language with enough documents, and one with null for all: _ref, _common, _word_share, _class_share.

    df: _text, _lang.
    """
    size, classes = rules.common_words, len(CLASSES) + 1
    words = df.select("_lang", F.explode(words_of(F.col("_text"))).alias("w")).groupBy("_lang", "w").agg(F.count("*").alias("n"))
    words = saved(words, "word-counts")
    # the words' characters are the texts' characters, so the texts needn't be read again for them
    counts = words.select("_lang", "n", class_counts(F.col("w")).alias("c"))
    sums = saved(counts.groupBy("_lang").agg(*(F.sum(F.get("c", F.lit(k)) * F.col("n")).alias(f"c{k}") for k in range(classes))), "class-sums")
    docs = saved(df.groupBy("_lang").agg(F.count("*").alias("docs")), "language-sizes")
    known = F.broadcast(docs.filter(F.col("_lang").isNotNull() & (F.col("docs") >= rules.min_docs)).select("_lang"))
    every = sum((F.col(f"c{k}") for k in range(classes)), F.lit(0))
    pooled = sums.groupBy().agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(classes))).withColumn("_lang", F.lit(None).cast("string"))
    chars = sums.join(known, "_lang", "left_semi").unionByName(pooled).filter(F.col("c0").isNotNull())
    chars = chars.select("_lang", F.array(*(F.col(f"c{k}") / F.greatest(every, F.lit(1)) for k in range(classes))).alias("_class_share"))
    lower = words.groupBy("_lang", F.lower("w").alias("w")).agg(F.sum("n").alias("n"))
    by_lang = lower.join(known, "_lang", "left_semi").unionByName(lower.groupBy("w").agg(F.sum("n").alias("n")).withColumn("_lang", F.lit(None).cast("string")))
    # a language's words meet in one group only after each of many slices has kept its own most common ones
    slices = W.partitionBy("_lang", F.pmod(F.xxhash64("w"), F.lit(64))).orderBy(F.desc("n"), "w")
    best = by_lang.withColumn("r", F.row_number().over(slices)).filter(F.col("r") <= size).drop("r")
    best = best.withColumn("r", F.row_number().over(W.partitionBy("_lang").orderBy(F.desc("n"), "w"))).filter(F.col("r") <= size)
    totals = by_lang.groupBy("_lang").agg(F.sum("n").alias("_all"))
    best = best.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n"))).alias("top"))
    shares = best.join(totals, best["_lang"].eqNullSafe(totals["_lang"])).select(
        best["_lang"].alias("_of"),
        F.transform("top", lambda x: x["w"]).alias("_common"),
        F.expr(f"transform(sequence(0, {size}), i -> coalesce(if(i < {size}, get(top, i).n, _all - aggregate(top, 0L, (a, x) -> a + x.n)), 0L) / _all)").alias("_word_share"),
    )
    return chars.join(shares, chars["_lang"].eqNullSafe(shares["_of"]), "left").select(chars["_lang"].alias("_ref"), "_common", "_word_share", "_class_share")


def quality_rules(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rules: Rules = Rules()) -> DataFrame:
    docs = df.select(F.col(id_column).alias("_id"), text_of(text_column).alias("_text"), F.col(lang_column).cast("string").alias("_lang"))
    refs = saved(references(docs.select("_text", "_lang"), rules), "references")
    model = F.struct("_common", F.array_join("_common", ",").alias("_listed"), "_word_share", "_class_share")
    own = refs.filter(F.col("_ref").isNotNull())
    pooled = refs.filter(F.col("_ref").isNull()).select(model.alias("_pool"))
    size = rules.common_words

    joined = docs.join(own.select("_ref", model.alias("_own")), docs["_lang"] == own["_ref"], "left")
    joined = joined.join(F.broadcast(pooled), F.lit(True), "left")  # one row
    lines = F.filter(F.split("_text", "\n"), lambda x: F.ltrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = joined.select("_id", "_text", F.coalesce("_own", "_pool").alias("_model"), words_of(F.col("_text")).alias("_words"), lines.alias("_lines"), class_counts(F.col("_text")).alias("_classes"))
    out = repeated_words(out)
    # a search in one text is several times faster than in an array, but its separator must be in no common word
    listed = F.transform("_words", lambda w: F.find_in_set(F.lower(w), F.col("_model._listed")))
    searched = F.transform("_words", lambda w: F.array_position(F.col("_model._common"), F.lower(w)).cast("int"))
    separate = F.size(F.split(F.col("_model._listed"), ",")) == F.size("_model._common")
    out = out.withColumn("_places", F.array_remove(F.when(separate, listed).otherwise(searched), 0))
    n, chars = F.size("_words"), F.length("_text")
    counted = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: (F.size("_places") - F.size(F.array_remove("_places", k))) / n)
    out = out.withColumn("_word_bins", F.concat(counted, F.array((n - F.size("_places")) / n)))
    in_words = chars - F.get("_classes", F.lit(1))
    out = out.withColumn("_class_bins", F.transform("_classes", lambda c, i: F.when(i == 1, 0.0).otherwise(c / in_words)))
    far_words = (n >= rules.min_words) & (_distance(F.col("_word_bins"), F.col("_model._word_share")) > rules.max_word_distance)
    far_chars = (chars >= rules.min_chars) & (_distance(F.col("_class_bins"), F.col("_model._class_share")) > rules.max_class_distance)
    words = n.cast("long")
    failed = (words < rules.min_words_base) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * words)
    return out.select(
        F.col("_id").alias("doc_id"),
        words.alias("n_words"),
        in_words.cast("long").alias("word_chars"),
        F.get("_classes", F.lit(len(CLASSES) - 1)).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(~F.coalesce(far_words, F.lit(False)) & ~F.coalesce(far_chars, F.lit(False))).alias("kept"),
    )
