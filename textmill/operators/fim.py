"""Fill-in-the-middle: which documents are turned, and into what, as array expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.numbers import ramp
from textmill.functions.text import strip, uniform

#: Fixed value: a function's head and docstring; `.` stands for no line end, and only \n ends a line.
DOCSTRING = r"""(?md)^(?<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+\w+[ \t]*\([\s\S]*?\)[ \t]*(?:->[\s\S]*?)?:[ \t]*\n\k<indent>[ \t]+(?<q>\x22{3}|\x27{3})[\s\S]*?\k<q>"""


@dataclass(frozen=True)
class Fim:
    categories: tuple[str, ...] = ("python_code", "other_code")
    min_tokens: int = 8
    start: float = 0.0
    most: float = 0.5
    ramp_tokens: int = 1_000_000
    docstring_fraction: float = 0.0
    end_fraction: float = 0.1
    psm_fraction: float = 0.5
    filename_probability: float = 0.5
    seed: int = 42
    prefix: str = "<fim_prefix>"
    middle: str = "<fim_middle>"
    suffix: str = "<fim_suffix>"
    filename: str = "<filename>"


def probability(seen: Column, fim: Fim) -> Column:
    return ramp(seen, fim.start, fim.most, fim.ramp_tokens)


def with_filename(tokens: Column, path: Column, path_tokens: Column, chance: Column, fim: Fim) -> Column:
    """Tokens with the file's name before them, where there is one and the draw says so."""
    named = path.isNotNull() & (path != "") & (chance < fim.filename_probability)
    return F.when(named, F.concat(F.array(F.lit(fim.filename)), path_tokens, tokens)).otherwise(tokens)


def _between(tokens: Column, begin: Column, end: Column) -> Column:
    return F.slice(tokens, begin + 1, F.greatest(end - begin, F.lit(0)))


def transform(
    docs: DataFrame, fim: Fim, *, key: str = "seq", tokens: str = "tokens", seen: str = "position",
    encode: Callable[[Column], Column] | None = None, text: str = "text", path: str | None = None, end: str | None = None,
) -> DataFrame:
    """Adds `mode` and replaces the tokens.

    docs: category, source_id, key, tokens (array<string>), seen (tokens before the document).  Every
    draw is a function of (seed, source, key, its name), so neither order nor partitioning matters.
    With `encode` (text to tokens): a path goes before the tokens by draw, and Python code is cut after
    a docstring by draw, where both sides have four tokens.  With `end`, every document ends in that token.
    """
    draw = lambda name: uniform(str(fim.seed), F.col("source_id"), F.col(key), name)
    mark = lambda x: F.array(F.lit(x))
    named = lambda t, name: with_filename(t, F.col(path), encode(F.concat(F.col(path), F.lit("\n"))), draw(name), fim) if encode and path else t
    out = docs.withColumn("_t", named(F.col(tokens), "filename"))
    t, n = F.col("_t"), F.size("_t")
    eligible = F.coalesce(F.col("category").isin(*fim.categories) & (n >= fim.min_tokens) & (draw("coin") < probability(F.col(seen), fim)), F.lit(False))
    least = max(1, fim.min_tokens // 2)
    end_cut = (F.lit(least) + F.floor(draw("end-cut") * (n - 2 * least + 1))).cast("int")
    # two different cuts in 1..n-1: the second draw skips the first
    one = (F.lit(1) + F.floor(draw("cut-1") * (n - 1))).cast("int")
    two = (F.lit(1) + F.floor(draw("cut-2") * (n - 2))).cast("int")
    two = F.when(two >= one, two + 1).otherwise(two)
    kind = F.when(~eligible, "standard")
    if encode and fim.docstring_fraction > 0:
        wanted = eligible & (F.col("category") == "python_code") & (draw("docstring") < fim.docstring_fraction)
        out = out.withColumn("_s", F.when(wanted, split_at_docstring(F.col(text), draw("docstring-match"))))
        out = out.withColumn("_d", F.when(strip("_s.rest") != "", F.struct(named(encode(F.col("_s.prompt")), "docstring-filename").alias("head"), encode(F.col("_s.rest")).alias("body"))))
        kind = kind.when(F.coalesce((F.size("_d.head") >= 4) & (F.size("_d.body") >= 4), F.lit(False)), "docstring")
    kind = kind.when(draw("end") < fim.end_fraction, "end").when(draw("psm") < fim.psm_fraction, "psm").otherwise("spm")
    out = out.withColumns({"_a": F.least(one, two), "_b": F.greatest(one, two), "_end": end_cut, "_kind": kind})
    before, middle, after = _between(t, F.lit(0), F.col("_a")), _between(t, F.col("_a"), F.col("_b")), _between(t, F.col("_b"), n)
    pre, mid, suf = mark(fim.prefix), mark(fim.middle), mark(fim.suffix)
    turned = F.when(F.col("_kind") == "end", F.concat(pre, _between(t, F.lit(0), F.col("_end")), suf, mid, _between(t, F.col("_end"), n)))
    turned = turned.when(F.col("_kind") == "psm", F.concat(pre, before, suf, after, mid, middle)).when(F.col("_kind") == "spm", F.concat(suf, after, pre, before, mid, middle))
    if "_d" in out.columns:
        turned = turned.when(F.col("_kind") == "docstring", F.concat(pre, F.col("_d.head"), suf, mid, F.col("_d.body")))
    turned = turned.otherwise(t)
    turned = F.concat(turned, mark(end)) if end is not None else turned
    mode = F.when(F.col("_kind") == "standard", "standard").when(F.col("_kind") == "spm", "fim_spm").otherwise("fim_psm")
    return out.withColumns({"_turned": turned, "mode": mode}).withColumn(tokens, F.col("_turned")).drop("_t", "_s", "_d", "_a", "_b", "_end", "_kind", "_turned")


def split_at_docstring(text: Column, draw: Column) -> Column:
    """struct(prompt, rest): the text up to the end of one of its functions' docstrings, and what follows; null without any.

    The drawn match's end is found by walking over the matches before it: each begins at or after the
    end of the last.
    """
    found = F.regexp_extract_all(text, F.lit(DOCSTRING), F.lit(0))
    at = F.least(F.floor(draw * F.size(found)), F.size(found) - 1).cast("int")
    end = F.aggregate(F.slice(found, 1, at + 1), F.lit(0), lambda e, m: e + F.call_function("instr", F.substr(text, e + 1), m) - 1 + F.length(m))
    return F.when(F.size(found) > 0, F.struct(F.substr(text, F.lit(1), end).alias("prompt"), F.substr(text, end + 1).alias("rest")))
