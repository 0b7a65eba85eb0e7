"""String functions with Python's semantics (Unicode white space, line ends), as Column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four separators that Python's str.strip also takes.
SPACE = r"[\s\x1c-\x1f]"
#: What ends a line for Python's str.splitlines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Names of roles, and extensions with the languages that they stand for.
_NAMES = {"user": ("human", "user", "prompter", "instruction"), "assistant": ("gpt", "assistant", "bot", "model", "response")}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), f"(?U)^{SPACE}+|{SPACE}+$", "")


def rstrip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), f"(?U){SPACE}+$", "")


def clean(x: Column | str) -> Column:
    """Stripped text; null is empty."""
    return F.coalesce(strip(col(x).cast("string")), F.lit(""))


def lines(x: Column | str) -> Column:
    """Lines without their ends; a final line end opens no line."""
    parts = F.split(col(x), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def collapse(x: Column | str) -> Column:
    """White space runs as one space, none at the ends; null is empty."""
    return strip(F.regexp_replace(F.coalesce(col(x), F.lit("")), f"(?U){SPACE}+", " "))


def first_text(*fields: Column | str) -> Column:
    """The first field with more than white space, stripped; else empty."""
    return F.coalesce(*(F.nullif(strip(f), F.lit("")) for f in fields), F.lit(""))


def join_fields(*fields: Column | str) -> Column:
    """Fields joined by blank lines; null fields are skipped, empty ones are not."""
    return F.concat_ws("\n\n", *(col(f) for f in fields))


def normal_language(x: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(strip(x)), rf"(?U)[\s\x1c-\x1f_-]+", ""), F.lit(""))


def extension_language(path: Column | str) -> Column:
    """The language that a path's extension stands for, or null."""
    low = F.lower(col(path))
    # fixed values
    known = {".py": "python", ".ipynb": "jupyternotebook", ".js": "javascript", ".jsx": "javascript", ".c": "c", ".h": "c", ".rs": "rust", ".go": "go"}
    return F.coalesce(*(F.when(low.endswith(ext), F.lit(name)) for ext, name in known.items()))


def normal_role(x: Column | str) -> Column:
    low = F.lower(clean(x))
    out = F.when(low == "", "user")
    for name, others in _NAMES.items():
        out = out.when(low.isin(*others), name)
    return out.otherwise(low)


def words(x: Column | str) -> Column:
    """The default tokenizer of queries that SQL checks: runs without ASCII white space."""
    return F.array_remove(F.split(F.coalesce(col(x), F.lit("")), r"[\x20\x09-\x0D]+"), "")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone, whatever the order of rows."""
    text = F.concat_ws("#", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def polynomial_hash(x: Column | str, base: int = 131, modulus: int = 2**31 - 1) -> Column:
    points = F.transform(F.filter(F.split(col(x), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(0).cast("long"), lambda a, c: F.pmod(a * base + c, F.lit(modulus)))


def epoch_seed(source: Column | str, epoch: Column, seed: int) -> Column:
    return F.pmod(F.lit(seed).cast("long") + polynomial_hash(source) + epoch.cast("long") * 1_000_003, F.lit(2**32))


def file_name(x: Column | str, longest: int = 120) -> Column:
    safe = F.substring(F.regexp_replace(strip(x), r"[^A-Za-z0-9_.-]+", "_"), 1, longest)
    return F.when(F.coalesce(safe, F.lit("")) == "", "default").otherwise(safe)


def step_number(name: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(name), r"step_(\d+)", 1), F.lit("")).cast("long")


def strip_prefixes(x: Column | str, prefixes: Sequence[str], until_stable: bool = False) -> Column:
    """Takes each prefix off once, in order; or all of them, in any order, until none is left."""
    if until_stable:
        return F.regexp_replace(col(x), "^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")+", "")
    out = col(x)
    for p in prefixes:
        out = F.regexp_replace(out, "^" + p.replace(".", r"\."), "")
    return out


def boolean(x: Column | str) -> Column:
    low = F.lower(strip(col(x).cast("string")))
    return F.when(low.isin("1", "true", "yes", "y", "on"), True).when(low.isin("0", "false", "no", "n", "off"), False)


def base_split(x: Column | str) -> Column:
    """`train[:100]` -> `train`; without a name, the split itself."""
    name = F.trim(F.element_at(F.split(col(x), r"\["), 1))
    return F.when(name == "", col(x)).otherwise(name)


def argument(args: Column | str, flag: str) -> Column:
    """The element after a flag, or null."""
    at = F.array_position(col(args), flag)
    return F.when(at > 0, F.get(col(args), at.cast("int")))


def task_names(args: Column | str, flag: str = "--tasks") -> Column:
    """The tasks that a command names after a flag, separated by commas: lower case, stripped, blank ones left out."""
    return F.coalesce(F.filter(F.transform(F.split(argument(args, flag), ","), lambda t: F.lower(strip(t))), lambda t: t != ""), F.array().cast("array<string>"))


#: Texts that stand for no target at all.
NO_TARGET = ("none", "null", "false", "off", "")


def report_targets(x: Column | str) -> Column:
    """Where to report to: a comma-separated text as a list; none for null and for words that stand for nothing."""
    names = F.filter(F.transform(F.split(col(x), ","), lambda t: strip(t)), lambda t: t != "")
    return F.when(F.lower(col(x)).isin(*NO_TARGET) | col(x).isNull(), F.array().cast("array<string>")).otherwise(names)


def blake2s_32(x: Column | str) -> Column:
    """The first four bytes of a text's blake2s digest as an integer; Spark has no such function."""
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else int.from_bytes(hashlib.blake2s(v.encode(), digest_size=4).digest(), "big")).astype("Int64")

    return F.pandas_udf(run, "long")(col(x))


def repository_parts(url: Column | str) -> Column:
    """struct(repo, revision, file) of a file's URL in a model repository: host/owner/name/(resolve|blob)/revision/path."""
    parts = F.split(F.regexp_replace(F.parse_url(col(url), F.lit("PATH")), "^/", ""), "/")
    at = F.when(F.get(parts, F.lit(2)).isin("resolve", "blob"), 2)
    return F.when(
        at.isNotNull() & (F.size(parts) > 4),
        F.struct(F.concat_ws("/", F.slice(parts, 1, 2)).alias("repo"), F.get(parts, F.lit(3)).alias("revision"), F.url_decode(F.array_join(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(1))), "/")).alias("file")),
    )


def unfenced(x: Column | str) -> Column:
    """Text without the code fence around it."""
    text = strip(col(x))
    rows = lines(text)
    rows = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    rows = F.when(strip(F.element_at(F.concat(F.array(F.lit("")), rows), -1)).startswith("```"), F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    return F.when(text.startswith("```"), strip(F.array_join(rows, "\n"))).otherwise(text)


#: The modes of token files and their numbers.
MODES = {"standard": 0, "fim_psm": 1, "fim_spm": 2}


def mode_number(name: Column | str) -> Column:
    """A mode's number by the beginning of a file's name; other names are standard."""
    out = F.lit(MODES["standard"])
    for mode, n in MODES.items():
        out = F.when(col(name).startswith(mode), n).otherwise(out)
    return out


def mode_name(number: Column | str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, MODES)), col(number).cast("int")), F.lit("standard"))


def iso_time(at: Column) -> Column:
    """A time as ISO text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def elapsed_seconds(begin: Column | str, end: Column | str) -> Column:
    """Seconds between two ISO texts or times, as a double; null if either can't be read."""
    read = lambda x: F.try_to_timestamp(col(x).cast("string")).cast("double")
    return read(end) - read(begin)


def digest(content: Column | str) -> Column:
    return F.sha2(col(content).cast("binary"), 256)
