"""Text out of HTML fragments, notebooks, questions and answers, and issues."""

from __future__ import annotations

import html
import html.entities
import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import col, normal_language, strip


#: Patterns of markup and what stands for it ($1: the group), in this order.
TAGS = ((r"(?is)<pre><code>(.*?)</code></pre>", "\n$1\n"), (r"(?is)<code>(.*?)</code>", "`$1`"), (r"<[^>]+>", " "))
BLANK_LINES = r"\n{3,}"


def without_tags(x: Column | str) -> Column:
    """Code blocks on lines of their own, inline code in backticks, other tags as spaces; entities stay."""
    out = col(x)
    for pattern, instead in TAGS:
        out = F.regexp_replace(out, pattern, instead)
    return out


def tidy(x: Column | str) -> Column:
    """At most one blank line in a row; stripped."""
    return strip(F.regexp_replace(col(x), BLANK_LINES, "\n\n"))


#: What may follow an ampersand as a reference, as the standard reads it.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Slots of the table of names, so that a look-up goes through a few entries.
NAME_SLOTS = 512


def _table(names: dict[str, str]) -> Column:
    """A literal array of maps, in which a name's map is found by its checksum."""
    slots: list[dict[str, str]] = [{} for _ in range(NAME_SLOTS)]
    for k, v in names.items():
        slots[zlib.crc32(k.encode()) % NAME_SLOTS][k] = v
    return F.array(*(F.create_map(*(F.lit(x) for pair in (m or {"": ""}).items() for x in pair)) for m in slots))


def _found(table: Column, name: Column) -> Column:
    return F.try_element_at(F.get(table, (F.crc32(name.cast("binary")) % NAME_SLOTS).cast("int")), name)


def _numbered(reference: Column) -> Column:
    """The character of a numeric reference; as the standard says, some stand for others and some for none."""
    digits = F.regexp_extract(reference, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    # more digits than any character has are too many; fewer fit a long
    n = F.coalesce(F.when(reference.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"), F.lit(0))
    n = F.when(F.length(digits) > 9, F.lit(0x110000)).otherwise(F.least(n, F.lit(0x110000))).cast("int")
    windows = {c: bytes([c]).decode("cp1252", "replace") for c in range(0x80, 0xA0)}
    others = {0: "\ufffd", 0x0D: "\r"} | {c: chr(c) if x == "\ufffd" else x for c, x in windows.items()}
    special = F.create_map(*(F.lit(x) for pair in others.items() for x in pair))
    none = n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    out_of_range = n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(F.map_contains_key(special, n), F.element_at(special, n)).when(out_of_range, "\ufffd").when(none, "").otherwise(char)


def unescaped(x: Column | str, closed: Sequence[str] = ()) -> Column:
    """Character references decoded, as the standard does it: the text is cut at its ampersands, and each part's reference looked up; of names without a semicolon the longest known beginning counts.

    closed: names that, unlike in the standard, count only with their semicolon.
    """
    names = {k: v for k, v in html.entities.html5.items() if k not in closed}
    plain = {k: v for k, v in names.items() if not k.endswith(";")}
    every, without = _table(names), _table(plain)
    longest = max(map(len, plain))

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        rest = F.substring(part, F.length(name) + 1, F.length(part))
        known = [F.when(F.length(name) > k, F.concat(_found(without, F.substring(name, 1, k)), F.substring(part, F.lit(k + 1), F.length(part)))) for k in range(longest, 1, -1)]
        named = F.coalesce(F.concat(_found(every, name), rest), *known, F.concat(F.lit("&"), part))
        return F.when(name == "", F.concat(F.lit("&"), part)).when(name.startswith("#"), F.concat(_numbered(name), rest)).otherwise(named)

    parts = F.split(col(x), "&", -1)
    decoded = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(one(part)))
    return F.when(F.contains(col(x), F.lit("&")), F.array_join(decoded, "")).otherwise(col(x))


def strip_html(x: Column | str, closed: Sequence[str] = ()) -> Column:
    return tidy(unescaped(without_tags(x), closed))


def flat(value: object) -> str:
    """All values of nested lists and objects, in order, with blank lines between; nulls inside are skipped."""
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        return "\n\n".join(map(flat, (v for v in value if v is not None)))
    return "" if value is None else value if isinstance(value, str) else str(value)


@dataclass(frozen=True)
class Slot:
    """A field of a JSON row, and where in it the texts are.

    parts: fields of an object, one of which is its text; lists: fields of an object, one of which has
    the items (without them, and with `itself`, the object is the one item).  alone: if it has a text,
    nothing else of the row counts, and markup stays.
    """

    field: str
    parts: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    itself: bool = False
    rest: bool = False  # an object without such a part is flattened
    alone: bool = False


#: The fields that hold texts, in order of preference, by processor.
SAID = ("text", "body", "comment", "content", "description")
THREAD = ("events", "comments", "items")
SLOTS = {
    "stackexchange_preference_qa": (Slot("question", ("text", "body"), rest=True), Slot("answers", ("text", "body", "content"), ("answers", "text"))),
    "github_issue_conversation": (
        Slot("content", alone=True), Slot("title"), Slot("body"), Slot("description"),
        Slot("events", SAID, THREAD, itself=True), Slot("comments", SAID, THREAD, itself=True),
    ),
}
NOTEBOOK = "python_notebook_code_cells"


def _held(value: dict, fields: tuple[str, ...]) -> list:
    return [value[f] for f in fields if value.get(f)][:1]


def _items(value: object, slot: Slot) -> list:
    if isinstance(value, dict) and slot.lists:
        value = next(iter(_held(value, slot.lists)), [value] if slot.itself else [])
    return value if isinstance(value, list) and slot.lists else [value]


def _bare(text: str) -> str:
    for pattern, instead in TAGS:
        text = re.sub(pattern, instead.replace("$1", r"\1"), text)
    return re.sub(BLANK_LINES, "\n\n", html.unescape(text)).strip()


def gathered(row: object, slots: tuple[Slot, ...]) -> str:
    """A row's texts, slot by slot, without markup, with blank lines between; what is no object has none."""
    out: list[str] = []
    for slot in slots if isinstance(row, dict) else ():
        found = []
        for item in _items(row.get(slot.field), slot):
            if isinstance(item, dict) and slot.parts:
                item = _held(item, slot.parts) or (item if slot.rest else "")
            found.append(flat(item).strip() if slot.alone else _bare(flat(item)))
        found = [x for x in found if x]
        if slot.alone and found:
            return found[0]
        out += found
    return "\n\n".join(out)


#: JSON as Python reads it, with NaN and infinities, integers of so many digits and strings of any length; `whole_json` adds a level to a thousand.
JSON_READ = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true", "maxNumLen": "4300", "maxStringLen": str(2**31 - 1), "maxNestingDepth": "1001"}


def whole_json(x: Column | str) -> Column:
    """A list: the value of a text that is one JSON value from end to end, as a variant; of other texts, nothing.

    Spark's parsers stop behind the first value, whatever follows it.  So the text is read as an item before
    its own checksum, which comes second, and last, only where all of the text belongs to the first item.
    """
    text = col(x)
    mark = F.sha2(text, 256)
    items = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<variant>", JSON_READ)
    whole = F.filter(F.array(items), lambda v: (F.size(v) == 2) & (F.try_variant_get(F.get(v, F.lit(1)), "$", "string") == mark))
    return F.transform(whole, lambda v: F.get(v, F.lit(0)))


def notebook_code(x: Column | str) -> Column:
    """A Python notebook's code cells, blank lines between; text that isn't JSON stays, other JSON and other kernels give nothing.

    Expressions over a variant.  Parts of a cell's source that are no texts stand as JSON.
    """
    at = lambda v, path, kind: F.try_variant_get(v, path, kind)

    def told(book: Column) -> Column:
        names = [F.nullif(normal_language(at(book, f"$.metadata.{path}", "string")), F.lit("")) for path in ("language_info.name", "kernelspec.language", "kernelspec.name")]
        foreign = ~F.coalesce(F.contains(F.coalesce(*names), F.lit("python")), F.lit(True))
        code = F.filter(at(book, "$.cells", "array<variant>"), lambda c: at(c, "$.cell_type", "string") == "code")
        sources = F.transform(code, lambda c: F.coalesce(F.array_join(F.transform(at(c, "$.source", "array<variant>"), lambda p: at(p, "$", "string")), ""), at(c, "$.source", "string")))
        cells = F.array_join(F.filter(sources, lambda s: strip(s) != ""), "\n\n")
        return F.when(foreign, "").otherwise(F.coalesce(cells, F.lit("")))

    return F.coalesce(F.get(F.transform(whole_json(x), told), F.lit(0)), col(x))


def _loaded(x: str) -> object:
    try:
        return json.loads(x)
    except (ValueError, RecursionError):
        return None


def processed(x: Column | str, processor: str | None) -> Column:
    """A JSON column through what a source's content_processor names.

    A notebook goes through expressions; rows whose shape differs from row to row, in which the order of
    an object's keys counts, through Arrow batches.
    """
    if not processor:
        return col(x)
    if processor == NOTEBOOK:
        return notebook_code(x)
    run = flat if processor == "flatten" else lambda row, slots=SLOTS[processor]: gathered(row, slots)
    return F.pandas_udf(lambda s: s.map(lambda v: run(_loaded(v)), na_action="ignore"), "string")(col(x))


def processed_document(processor: str | None, x: Column | str, fields: Sequence[Column | str]) -> Column:
    """A row's text by its processor; where that gives none, its text fields joined by blank lines."""
    return F.coalesce(F.nullif(processed(x, processor), F.lit("")), F.concat_ws("\n\n", *(col(f).cast("string") for f in fields)))


def typed_answers(question: Column, answers: Column) -> Column:
    """Question and answers of a typed row (string, array of strings), without Python: tags go, entities stay."""
    texts = F.filter(F.transform(answers, lambda a: tidy(without_tags(F.coalesce(a, F.lit(""))))), lambda a: a != "")
    return F.array_join(F.filter(F.concat(F.array(tidy(without_tags(F.coalesce(question, F.lit(""))))), texts), lambda a: a != ""), "\n\n")

