"""Scans: descriptors of sources, and readers for the formats that corpora come in."""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textmill.functions.text import normal_language

DESCRIPTOR = (
    "source_id string, enabled boolean, category string, weight double, text_fields array<string>, path_field string, languages array<string>,"
    " content_processor string, english_only boolean, format string, path string, split string"
)


@dataclass(frozen=True)
class Source:
    source_id: str
    category: str
    weight: float = 1.0
    enabled: bool = True
    text_fields: tuple[str, ...] = ("text",)
    path_field: str | None = None
    languages: tuple[str, ...] = ()
    content_processor: str | None = None
    english_only: bool = False
    format: str = "parquet"
    path: str | None = None
    split: str | None = None
    options: dict = field(default_factory=dict, hash=False)


def descriptors(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """The sources' table; it is as large as the configuration, so joins broadcast it."""
    rows = [(s.source_id, s.enabled, s.category, s.weight, list(s.text_fields), s.path_field, list(s.languages), s.content_processor, s.english_only, s.format, s.path, s.split) for s in sources]
    return spark.createDataFrame(rows, DESCRIPTOR)


def enabled(sources: DataFrame) -> DataFrame:
    return sources.filter(F.coalesce("enabled", F.lit(True)))


def scan(spark: SparkSession, source: Source) -> DataFrame:
    """Reads a source by its format; a JSON source is one object a line.  Splits are folders or file prefixes under the path."""
    if source.path is None:
        raise ValueError(f"source {source.source_id} has no path")
    path = source.path if not source.split else f"{source.path.rstrip('/')}/{source.split.split('[')[0].strip() or source.split}*"
    if source.format == "arrow":
        spark.dataSource.register(ArrowFiles)
    return spark.read.format(source.format).options(**source.options).load(path)


def configured(spark: SparkSession, source: dict, config: dict, environment: Mapping[str, str], *, format: str = "parquet") -> DataFrame:
    """Reads a source as a configuration describes it: dataset (a path), data_dir, data_files (a list, or lists by split), split, and what `reader_options` makes of the rest, as the reader's options.

    A token goes to the reader as an option too, and is in no plan's text: Spark redacts it.
    """
    options = reader_options(source, config, environment)
    folder = "/".join(x.strip("/") if i else x.rstrip("/") for i, x in enumerate(x for x in (source["dataset"], options.pop("data_dir", "")) if x))
    files, split = options.pop("data_files", None), (source.get("split") or "train").split("[")[0].strip()
    if isinstance(files, Mapping):
        if split not in files:
            raise ValueError(f"source {source.get('id')} has no files for split {split}")
        files = files[split]
    names = [files] if isinstance(files, str) else list(files or [])
    if options.get("name") and not names:
        folder = f"{folder}/{options['name']}"
    if not names:
        names = [f"{split}*"]
    if format == "arrow":
        spark.dataSource.register(ArrowFiles)
    return spark.read.format(format).options(**{k: str(v) for k, v in options.items()}).load([f"{folder}/{x}" for x in names])


def scan_either(spark: SparkSession, first: Source, otherwise: Source) -> DataFrame:
    """The first source, or the other one where the first can't be read."""
    from pyspark.errors import PySparkException

    try:
        return scan(spark, first)
    except PySparkException:
        return scan(spark, otherwise)


def documents(raw: DataFrame, source: Source) -> DataFrame:
    """Rows of a source as documents: source_id, category, path, language, text."""
    names = {c.lower() for c in raw.columns}
    language = [F.col(c).cast("string") for c in ("language", "lang") if c in names]
    return raw.select(
        F.lit(source.source_id).alias("source_id"),
        F.lit(source.category).alias("category"),
        (F.col(source.path_field).cast("string") if source.path_field else F.lit(None).cast("string")).alias("path"),
        (F.coalesce(*language) if language else F.lit(None).cast("string")).alias("language"),
        F.concat_ws("\n\n", *(F.col(f).cast("string") for f in source.text_fields)).alias("text"),
    )


def bundles(raw: DataFrame, blobs: DataFrame, source: Source) -> DataFrame:
    """Rows with arrays of files as documents, one for each file that is neither vendored nor generated.

    raw: files array<struct<path, language, blob_id, src_encoding, is_vendor, is_generated>>; blobs:
    blob_id, content.  Files are filtered before their contents are joined.
    """
    files = raw.select(F.explode("files").alias("f")).select("f.*")
    files = files.filter(~F.coalesce("is_vendor", F.lit(False)) & ~F.coalesce("is_generated", F.lit(False)))
    if source.languages:
        files = files.filter(normal_language("language").isin(*(x.lower().replace(" ", "").replace("-", "").replace("_", "") for x in source.languages)))
    joined = files.join(blobs, "blob_id")
    return joined.select(F.lit(source.source_id).alias("source_id"), F.lit(source.category).alias("category"), "path", "language", decoded("content", "src_encoding").alias("text"))


def decoded(content: str, encoding: str) -> Column:
    """Bytes as text by each row's own encoding (none: UTF-8); what isn't in it becomes a replacement character, an unknown encoding gives null."""
    def run(contents: pd.Series, encodings: pd.Series) -> pd.Series:
        out = []
        for c, e in zip(contents, encodings, strict=True):
            try:
                out.append(None if c is None else c.decode(e or "utf-8", "replace"))
            except LookupError:
                out.append(None)
        return pd.Series(out, dtype=object)

    # valid UTF-8 stays in the JVM; Python sees the rest
    plain = F.coalesce(F.lower(F.regexp_replace(F.col(encoding), "[-_ ]", "")), F.lit("utf8")).isin("utf8", "") & F.is_valid_utf8(F.col(content).cast("string"))
    other = F.pandas_udf(run, "string")(F.when(~plain, F.col(content)), F.col(encoding))
    return F.when(plain, F.col(content).cast("string")).otherwise(other)


def gunzipped(spark: SparkSession, path: str) -> DataFrame:
    """blob_id (the file's name), content (decompressed), from a folder of gzip files; damaged files are left out by a null content filter."""
    def run(values: pd.Series) -> pd.Series:
        def one(v: bytes) -> bytes | None:
            try:
                return gzip.decompress(v)
            except OSError:
                return None

        return values.map(one)

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.gz$", "").alias("blob_id"), F.pandas_udf(run, "binary")("content").alias("content")).filter("content IS NOT NULL")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON lines log; blank and damaged lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def item_text(items: DataFrame, item_id: int, *, id_column: str = "item_id", text_column: str = "text") -> str:
    """The prompt of one benchmark item; KeyError if there is none."""
    found = items.filter(F.col(id_column) == item_id).select(F.col(text_column).alias("t")).limit(1).collect()
    if not found:
        raise KeyError(f"no item {item_id}")
    return found[0]["t"]


class _Files(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArrowReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Files]:
        return [_Files(p) for p in arrow_files(self.path)]

    def read(self, partition: _Files) -> Iterator:
        import pyarrow as pa

        with open_arrow(partition.path) as source:
            try:
                reader = pa.ipc.open_stream(source)
                yield from reader
            except pa.ArrowInvalid:
                source.seek(0)
                reader = pa.ipc.open_file(source)
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)


def _fs(path: str):
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def arrow_files(pattern: str) -> list[str]:
    """Files that end in .arrow, sorted, whose name begins as the pattern does before its star; none is an error."""
    from pyarrow import fs

    folder, _, prefix = pattern.rstrip("*").rpartition("/") if pattern.endswith("*") else (pattern, "", "")
    system, root = _fs(folder)
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith(prefix) and f.base_name.endswith(".arrow"))
    if not found:
        raise FileNotFoundError(f"no .arrow file under {pattern}")
    return found


def open_arrow(path: str):
    system, name = _fs(path)
    return system.open_input_file(name)


class ArrowFiles(DataSource):
    """Reads Arrow IPC files (stream or file format), one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "arrow"

    def schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        with open_arrow(arrow_files(self.options["path"])[0]) as source:
            try:
                return from_arrow_schema(pa.ipc.open_stream(source).schema)
            except pa.ArrowInvalid:
                source.seek(0)
                return from_arrow_schema(pa.ipc.open_file(source).schema)

    def reader(self, schema) -> _ArrowReader:
        return _ArrowReader(self.options["path"])


def generations(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """task_no, candidate, text from a JSON list of lists of strings, tasks numbered from `first`."""
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("g"))
    tasks = lists.select(F.posexplode("g").alias("pos", "texts"))
    return tasks.select((F.col("pos") + first).alias("task_no"), F.posexplode("texts").alias("candidate", "text"))


#: Fields of a source that its reader takes as options, and where an access token may stand.
OPTION_FIELDS = ("data_dir", "data_files")
TOKEN_NAMES = ("HF_TOKEN", "HUGGINGFACE_TOKEN", "HUGGING_FACE_HUB_TOKEN")


def reader_options(source: dict, config: dict, environment: Mapping[str, str]) -> dict:
    """A configured source's reader options: its subset's name, folders, files, trust and token; unset and empty ones are left out.

    The token is the source's own, else the configuration's, else the environment's.
    """
    options = {"name": source.get("config_name") or source.get("name")} | {f: source.get(f) for f in OPTION_FIELDS}
    options["trust_remote_code"] = True if source.get("trust_remote_code") else None
    options["token"] = next((t for t in (source.get("hf_token"), config.get("data", {}).get("hf_token"), *(environment.get(n) for n in TOKEN_NAMES)) if t), None)
    return {k: v for k, v in options.items() if v}


def check_access(sources: Sequence[Source], gated: Sequence[str], environment: Mapping[str, str], config: dict | None = None) -> None:
    """Raises PermissionError that names every source which can't be read yet; called before a shard is begun."""
    token = bool(reader_options({}, config or {}, environment).get("token"))
    keys = bool(environment.get("AWS_ACCESS_KEY_ID") and environment.get("AWS_SECRET_ACCESS_KEY")) or bool(environment.get("AWS_PROFILE"))
    wrong = [x for x in (missing_access(s, gated, token, keys) for s in sources) if x]
    if wrong:
        raise PermissionError("; ".join(wrong))


def missing_access(source: Source, gated: Sequence[str], has_token: bool, has_keys: bool) -> str | None:
    """Why a source can't be read yet, or None: gated sets need a token, signed stores need keys."""
    if source.enabled and source.path in gated and not has_token:
        return f"{source.source_id}: {source.path} needs an access token"
    if source.enabled and (source.path or "").startswith(("s3://", "s3a://")) and not has_keys:
        return f"{source.source_id}: its store needs keys"
    return None
