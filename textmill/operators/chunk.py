"""Python source as chunks: functions, classes and methods, each with its module's imports."""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import uniform


@dataclass(frozen=True)
class Chunking:
    split_probability: float = 0.35
    max_parse_chars: int = 200_000
    min_chars: int = 32
    max_chars: int = 24_000
    max_chunks: int = 32
    imports: bool = True
    import_chars: int = 4_000
    functions: bool = True
    classes: bool = False
    methods: bool = True


def merged(common: dict, own: dict) -> Chunking:
    """Settings of a source: its own over the common ones over the defaults; names that are no setting are an error."""
    return Chunking(**(common | own))


def _first_line(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])


class _Source:
    """Line slices of a module.  Lines end as the parser counts them: \\n, \\r\\n and \\r only."""

    def __init__(self, text: str):
        self.lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)

    def between(self, first: int, last: int) -> str:
        return "".join(self.lines[first - 1 : max(first - 1, last)]).rstrip() + "\n"

    def of(self, node: ast.AST) -> str:
        return self.between(_first_line(node), node.end_lineno)

    def imports(self, body: list[ast.stmt], most: int) -> str:
        if most <= 0:
            return ""
        found = "".join(self.of(x) for x in body if isinstance(x, (ast.Import, ast.ImportFrom))).strip()[:most].rstrip()
        return found and found + "\n\n"

    def head(self, node: ast.ClassDef) -> str:
        """A class up to its first statement, and that statement too if it is the docstring."""
        first = node.body[0]
        out = self.between(_first_line(node), max(_first_line(node), _first_line(first) - 1))
        said = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
        return out + self.of(first) if said else out


def chunks(text: str, c: Chunking) -> list[tuple[str, str]]:
    """(kind, text) of a module's chunks; none if it is too long, can't be parsed, or has none of the right size."""
    if 0 < c.max_parse_chars < len(text):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    source = _Source(text)
    before = source.imports(module.body, c.import_chars) if c.imports else ""
    function = (ast.FunctionDef, ast.AsyncFunctionDef)
    found: list[tuple[str, str]] = []
    for node in module.body:
        if isinstance(node, function) and c.functions:
            found.append(("python_function", before + source.of(node)))
        if isinstance(node, ast.ClassDef):
            if c.classes:
                found.append(("python_class", before + source.of(node)))
            if c.methods:
                found += [("python_method", before + source.head(node) + source.of(x)) for x in node.body if isinstance(x, function)]
    sized = [(kind, x.strip() + "\n") for kind, x in found if c.min_chars <= len(x.strip()) <= c.max_chars]
    return sized[: c.max_chunks] if c.max_chunks else sized


def chunked(docs: DataFrame, c: Chunking, *, eligible: Column, text: str = "text", key: str = "seq", seed: int = 42) -> DataFrame:
    """Documents as chunks: adds chunk_type (null for a whole document) and chunk_no, and replaces the text; a chunk's language is Python.

    Only eligible documents under the length limit, and a drawn share of them, are parsed.
    """
    drawn = eligible & (uniform(str(seed), F.col(key), "chunk") < c.split_probability)
    short = F.length(text) <= c.max_parse_chars if c.max_parse_chars > 0 else F.lit(True)
    run = F.pandas_udf(lambda s: s.map(lambda x: [{"kind": k, "text": t} for k, t in chunks(x, c)] if x else []), "array<struct<kind:string,text:string>>")
    own = docs.withColumn("_parse", F.when(F.coalesce(drawn & short, F.lit(False)), F.col(text)))
    own = own.withColumn("_chunks", run(F.col("_parse")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.col(text).alias("text")))
    own = own.withColumn("_chunks", F.when(F.size("_chunks") > 0, F.col("_chunks")).otherwise(whole))
    out = own.select("*", F.posexplode("_chunks").alias("chunk_no", "_c")).withColumns({text: F.col("_c.text"), "chunk_type": F.col("_c.kind")})
    if "language" in docs.columns:
        out = out.withColumn("language", F.when(F.col("chunk_type").isNotNull(), "Python").otherwise(F.col("language")))
    return out.drop("_parse", "_chunks", "_c")


