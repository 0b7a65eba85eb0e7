"""Conversations and instruction pairs as labelled token sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.text import clean, first_text, normal_role, strip, uniform
from textmill.operators.evalkit import longest_failures

IGNORED = -100
#: Columns that may hold a conversation, and fields that may hold a message's role and content, in order.
LISTS = ("messages", "conversations", "conversation", "data")
ROLES = ("role", "from", "speaker")
CONTENTS = ("content", "value", "text", "message")
#: Fields that may hold prompts, their context and completions, in order.
PROMPTS = ("instruction", "input", "problem", "question", "prompt", "query", "task")
CONTEXTS = ("context", "additional_context")
COMPLETIONS = ("output", "response", "solution", "answer", "completion", "accepted_solution")


def message(m: Column, names: Sequence[str]) -> Column:
    """A struct with any of the fields' names as (role, content); the first content that isn't blank counts."""
    role = F.coalesce(*(m[f].cast("string") for f in ROLES if f in names), F.lit(None).cast("string"))
    return F.struct(normal_role(role).alias("role"), first_text(*(m[f].cast("string") for f in CONTENTS if f in names)).alias("content"))


def _conversation(list_: Column, names: Sequence[str]) -> Column:
    kept = F.filter(F.transform(F.filter(list_, lambda m: m.isNotNull()), lambda m: message(m, names)), lambda m: m["content"] != "")
    return F.when(F.exists(kept, lambda m: m["role"] == "assistant"), kept)


def messages(df: DataFrame, lists: Sequence[str] = LISTS) -> Column:
    """The first list that has an assistant's message; array<struct<role, content>> with blank contents dropped; null without any.

    Each list is an array of structs that name role and content in their own way; columns that are no such arrays are passed over.
    """
    found = []
    for name in lists:
        kind = df.schema[name].dataType if name in df.columns else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            found.append(_conversation(F.col(name), kind.elementType.fieldNames()))
    return F.coalesce(*found, F.lit(None).cast("array<struct<role:string,content:string>>"))


def rendered(role: Column, content: Column) -> Column:
    known = F.when(role.isin("system", "user", "assistant"), role).otherwise("user")
    return F.concat(F.lit("<|im_start|>"), known, F.lit("\n"), content, F.lit("<|im_end|>\n"))


def chat_text(list_: Column) -> Column:
    return F.array_join(F.transform(list_, lambda m: rendered(m["role"], m["content"])), "")


def labelled(list_: Column, encode) -> Column:
    """struct(ids, labels) of a conversation: an assistant's content and footer are labelled; null if nothing is.

    encode: text Column -> array<int> Column.
    """
    def part(m: Column) -> Column:
        role = F.when(m["role"].isin("system", "user", "assistant"), m["role"]).otherwise("user")
        head, body, foot = encode(F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))), encode(m["content"]), encode(F.lit("<|im_end|>\n"))
        said = F.concat(body, foot)
        return F.struct(F.concat(head, said).alias("ids"), F.concat(F.array_repeat(F.lit(IGNORED), F.size(head)), F.when(role == "assistant", said).otherwise(F.array_repeat(F.lit(IGNORED), F.size(said)))).alias("labels"))

    parts = F.transform(list_, part)
    labels = F.flatten(F.transform(parts, lambda p: p["labels"]))
    return F.when(F.exists(labels, lambda x: x != IGNORED), F.struct(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"), labels.alias("labels")))


def best_response(responses: Column, annotations: Column) -> Column:
    """The response whose model is rated highest; unrated ones have tiny ratings by place, the first of equals wins; blank ones never do.

    responses: array<struct<text, model>>; annotations: array<struct<model, rating double>> (the last of a model counts; map keys keep the last).
    """
    rated = F.map_from_entries(F.filter(F.transform(annotations, lambda a: F.struct(clean(a["model"]).alias("k"), a["rating"].alias("v"))), lambda e: (e["k"] != "") & e["v"].isNotNull()))
    rated = F.coalesce(rated, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    n = F.size(responses)
    scored = F.transform(responses, lambda r, i: F.struct(F.coalesce(F.element_at(rated, clean(r["model"])), (n - i) * F.lit(1e-6)).alias("rating"), (-i).alias("place"), clean(r["text"]).alias("text")))
    return F.coalesce(F.array_max(F.filter(scored, lambda s: s["text"] != ""))["text"], F.lit(""))


def prompt_and_completion(df: DataFrame, prompt_field: str | None = None, completion_field: str | None = None, best: Column | None = None) -> Column:
    """struct(prompt, completion) from a configured pair of fields, or from the first that hold text; null without both."""
    have = set(df.columns)
    prompt = first_text(*(f for f in PROMPTS if f in have))
    extra = first_text(*(f for f in CONTEXTS if f in have))
    prompt = F.when((prompt != "") & (extra != "") & ~F.contains(prompt, extra), F.concat(prompt, F.lit("\n\n"), extra)).otherwise(prompt)
    completion = first_text(*(f for f in COMPLETIONS if f in have))
    completion = F.when(completion == "", best).otherwise(completion) if best is not None else completion
    found = F.when((prompt != "") & (completion != ""), F.struct(prompt.alias("prompt"), completion.alias("completion")))
    if prompt_field and completion_field:
        p, c = clean(prompt_field), clean(completion_field)
        found = F.when((p != "") & (c != ""), F.struct(p.alias("prompt"), c.alias("completion"))).otherwise(found)
    return found


def pair_texts(prompt: Column, completion: Column) -> tuple[Column, Column]:
    return (
        F.concat(F.lit("<|im_start|>user\n"), strip(prompt), F.lit("\n<|im_end|>\n<|im_start|>assistant\n")),
        F.concat(strip(completion), F.lit("\n<|im_end|>\n")),
    )


def pair_labelled(prompt_ids: Column, completion_ids: Column) -> Column:
    good = (F.size(prompt_ids) > 0) & (F.size(completion_ids) > 0)
    return F.when(good, F.struct(F.concat(prompt_ids, completion_ids).alias("ids"), F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt_ids)), completion_ids).alias("labels")))


def raw_labelled(ids: Column, least: int = 8) -> Column:
    return F.when(F.size(ids) >= least, F.struct(ids.alias("ids"), ids.alias("labels")))


def docstring_labelled(prompt: Column, completion: Column, encode, *, least_chars: int = 16, least_tokens: int = 4) -> Column:
    p, c = encode(F.concat(F.regexp_replace(prompt, r"(?U)[\s\x1c-\x1f]+$", ""), F.lit("\n"))), encode(strip(completion))
    good = (F.length(strip(completion)) >= least_chars) & (F.size(p) > 0) & (F.size(c) >= least_tokens)
    return F.when(good, pair_labelled(p, c))


def truncated(example: Column, most: int, mode: str, *draw: Column | str) -> Column:
    """At most most + 1 tokens: a random stretch of raw text, the head of a docstring, or what is around a random labelled token.

    Null if fewer than two tokens or no label after the first are left.
    """
    ids, labels = example["ids"], example["labels"]
    longest = most + 1
    n = F.size(ids)
    if mode == "raw_completion":
        start = F.floor(uniform(*draw) * (n - longest + 1))
    elif mode == "docstring_completion":
        start = F.lit(0)
    else:
        at = F.filter(F.transform(labels, lambda x, i: F.when(x != IGNORED, i)), lambda i: i.isNotNull())
        chosen = F.get(at, F.least(F.floor(uniform(*draw) * F.size(at)), F.size(at) - 1).cast("int"))
        start = F.greatest(F.lit(0), F.least(chosen - longest // 2, n - longest))
    start = F.when(n > longest, start).otherwise(0).cast("int")
    ids, labels = F.slice(ids, start + 1, longest), F.slice(labels, start + 1, longest)
    good = (F.size(ids) >= 2) & F.exists(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != IGNORED)
    return F.when(good, F.struct(ids.alias("ids"), labels.alias("labels")))


def check_rejections(rows: DataFrame, usable: Column, *, source: str, order: str, most: int = 10_000) -> None:
    """Raises ValueError if a source has `most` rows in a row that give no example."""
    worst = longest_failures(rows, run=source, order=order, failed=~F.coalesce(usable, F.lit(False))).filter(F.col("longest") >= most).limit(1).collect()
    if worst:
        raise ValueError(f"source {worst[0][source]} has {worst[0]['longest']} unusable rows in a row")


def collated(df: DataFrame, *, batch: str, order: str, pad: int) -> DataFrame:
    """x, y and loss mask of each row, padded to its batch's longest.  df: batch, order, ids, labels; batches are small."""
    longest = df.groupBy(batch).agg(F.max(F.size("ids")).alias("_n"))
    wide = df.join(longest, batch)
    fill = lambda x, v: F.concat(F.col(x), F.array_repeat(F.lit(v), F.col("_n") - F.size(x)))
    wide = wide.withColumns({"_i": fill("ids", pad), "_l": fill("labels", IGNORED)})
    tail = lambda x: F.slice(x, 2, F.col("_n") - 1)
    return wide.select(batch, order, F.slice("_i", 1, F.col("_n") - 1).alias("x"), F.zip_with(tail("_l"), tail("_i"), lambda l, i: F.when(l != IGNORED, l).otherwise(i)).alias("y"), F.transform(tail("_l"), lambda l: l != IGNORED).alias("mask"))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column; rows where it is null are left out.

    A generator stands between the value and what uses it, so the optimizer can't copy a costly
    expression into every reference and into a pushed-down filter.
    """
    return df.withColumn(name, F.explode(F.array_compact(F.array(value))))


def formatted(df: DataFrame, encode, *, group: str, most: int, key: str, seed: int = 42, text_field: str | None = None, docstring_probability: float = 0.0, lists: list[str] | None = None) -> DataFrame:
    """df with `example` (struct of ids and labels) and `mode`; rows that give no example are left out.

    group: "raw_completion" takes text (a docstring's completion by draw, else the whole), any other
    takes a conversation from the first usable list, or an instruction pair.
    """
    from textmill.operators.fim import split_at_docstring

    seeds = (str(seed), F.col(key))
    if group == "raw_completion":
        fields = (text_field,) if text_field else tuple(c for c in ("content", "text", "code", "solution") if c in df.columns)
        pair = prompt_and_completion(df)
        text = first_text(*fields) if fields else F.lit("")
        text = F.when(text == "", F.concat_ws("\n\n", pair["prompt"], pair["completion"])).otherwise(text)
        own = df.withColumn("_t", text).filter(F.col("_t") != "")
        own = own.withColumn("_d", F.when(uniform(*seeds, "docstring") < docstring_probability, split_at_docstring(F.col("_t"), uniform(*seeds, "match"))))
        own = computed(own, "_x", F.struct(F.when(F.col("_d").isNotNull(), docstring_labelled(F.col("_d.prompt"), F.col("_d.rest"), encode)).alias("e"), encode(strip("_t")).alias("ids")))
        own = own.withColumn("_e", F.col("_x.e"))
        mode = F.when(F.col("_e").isNotNull(), "docstring_completion").otherwise("raw_completion")
        raw = truncated(raw_labelled(F.col("_x.ids")), most, "raw_completion", *seeds, "window")
        example = F.when(F.col("_e").isNotNull(), truncated(F.col("_e"), most, "docstring_completion", *seeds, "window")).otherwise(raw)
        return computed(own.withColumn("mode", mode), "example", example).drop("_t", "_d", "_e", "_x")
    pair = prompt_and_completion(df)
    own = df.withColumn("_m", messages(df, lists or LISTS))
    p, c = pair_texts(pair["prompt"], pair["completion"])
    encoded = F.when(F.col("_m").isNotNull(), labelled(F.col("_m"), encode)).when(pair.isNotNull(), pair_labelled(encode(p), encode(c)))
    own = computed(own, "_e", encoded)
    return computed(own.withColumn("mode", F.lit("instruction")), "example", truncated(F.col("_e"), most, "instruction", *seeds, "window")).drop("_m", "_e")
