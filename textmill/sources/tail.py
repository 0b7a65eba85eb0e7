"""The end of a log, read from its end: byte ranges of the last files, not a scan of all of it.

The files of a folder, in the order of their names, are one log.  A task reads one range; the ranges
together are the bytes asked for.  A line belongs to the range in which it begins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textmill.sources.readers import _fs

#: Bytes that one task reads, about.
RANGE = 1 << 18
LINES = "file int, at long, value string"


@dataclass(frozen=True)
class Range(InputPartition):
    """Bytes begin to end of a file; cut: whether the first line is dropped as a partial one."""

    number: int
    path: str
    begin: int
    end: int
    cut: bool


def log_files(path: str) -> tuple[object, list[tuple[str, int]]]:
    """The file system, and path and size of each file: the file itself, or a folder's, by name."""
    from pyarrow import fs

    system, root = _fs(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return system, []
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return system, sorted((f.path, f.size) for f in found)


class TailReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> Sequence[Range]:
        files, left, out = log_files(self.path)[1], self.most, []
        for number in range(len(files) - 1, -1, -1):
            path, size = files[number]
            begin = max(size - left, 0)
            for at in range(begin, size, RANGE):
                out.append(Range(number, path, at, min(at + RANGE, size), at == begin and begin > 0))
            left -= size - begin
            if left <= 0:
                break
        return out or [Range(-1, "", 0, 0, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.number < 0:
            return
        with _fs(self.path)[0].open_input_file(p.path) as f:
            size = f.size()
            # one byte before tells whether a line begins here; the first range's first line is dropped in any case
            before = b"" if p.begin == 0 else b"x" if p.cut else f.read_at(1, p.begin - 1)
            data, at = f.read_at(p.end - p.begin, p.begin), p.begin
            while not data.endswith(b"\n") and at + len(data) < size:  # the last line ends beyond the range
                more = f.read_at(1 << 14, at + len(data))
                stop = more.find(b"\n")
                data += more if stop < 0 else more[: stop + 1]
        if before not in (b"", b"\n"):
            first = data.find(b"\n") + 1
            if not first:
                return  # the whole range lies within one line
            data, at = data[first:], at + first
        places, lines = [], []
        for line in data.split(b"\n"):
            if at >= p.end or (not line and at + 1 > size):
                break
            places.append(at)
            lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            at += len(line) + 1
        yield pa.RecordBatch.from_arrays([pa.array([p.number] * len(lines), pa.int32()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=["file", "at", "value"])


class LogTail(DataSource):
    """Format `tail`: the whole lines among a log's last `bytes` bytes (1 MiB)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("bytes", 1 << 20)))


def tail_lines(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> DataFrame:
    """file, at, value: the lines that begin after the first line end among the last bytes; (file, at) orders them.  A log that isn't there has none."""
    spark.dataSource.register(LogTail)
    return spark.read.format("tail").option("bytes", most_bytes).load(path)


def tail_objects(spark: SparkSession, path: str, schema: str, most_bytes: int = 1 << 20) -> DataFrame:
    """The objects among them; blank and damaged lines are none."""
    found = tail_lines(spark, path, most_bytes).filter(F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{"))
    return found.withColumn("_o", F.from_json("value", schema, {"mode": "PERMISSIVE"})).orderBy("file", "at").select("_o.*")


def last_lines(spark: SparkSession, path: str, n: int, skip: str | None = None, first_bytes: int = 1 << 16) -> DataFrame:
    """The last n non-blank lines (a top-k report), without those that match `skip`: four times as many bytes are read until they hold as many lines, or the log ends."""
    total, most = sum(size for _, size in log_files(path)[1]), first_bytes
    while True:
        rows = tail_lines(spark, path, most).filter(F.trim("value") != "")
        rows = rows.filter(~F.col("value").rlike(skip)) if skip else rows
        if most >= total or rows.limit(n).count() >= n:
            return rows.orderBy(F.desc("file"), F.desc("at")).limit(n).orderBy("file", "at").select("value")
        most *= 4
