"""A source of documents as a stream that resumes at a row: epochs in seeded order, batches cut by tokens.

A table of Parquet files is cut into slices of consecutive rows.  An index, made once by Spark, has each
slice's rows and tokens.  An epoch goes through all slices in an order that the seed and the epoch alone
decide, and through a slice's rows in such an order too; without a seed, in the files' own order.  An
offset is an epoch and a number of rows in that order, so that a stream begins anywhere (`skip`), and a
batch takes slices until they hold `batch_tokens`; without that number a batch is what is left of an epoch.

Every batch's end is put down in the cursor's file before its rows are read, so a stream that is killed
goes on where its checkpoint says, with the same batches: each row of each epoch comes once.  A batch's
tasks read their own slices only, and only the columns asked for.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from textmill.plans.shared import file_system

#: Rows of a slice.
SLICE_ROWS = 1000


def write_index(spark: SparkSession, path: str, into: str, *, tokens: Column | None = None, slice_rows: int = SLICE_ROWS) -> None:
    """Writes the index of a Parquet table: file, first, rows, tokens of each slice (without `tokens`: rows)."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / slice_rows).alias("slice"), (F.lit(1) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long").alias("n"))
    index = rows.groupBy("file", "slice").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    index.select("file", (F.col("slice") * slice_rows).alias("first"), "rows", "tokens").coalesce(1).write.mode("overwrite").parquet(into)


def _open(uri: str):
    import os

    from pyarrow import fs

    if re.match(r"file:/(?!//)", uri):  # one slash, as Spark writes it
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


@dataclass(frozen=True)
class Part(InputPartition):
    """Rows begin to end of a slice, in the epoch's order; place: the first one's in the epoch."""

    file: str
    first: int
    rows: int
    begin: int
    end: int
    epoch: int
    place: int


class CorpusReader(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        if "cursor" not in options or "index" not in options:
            raise ValueError("a corpus stream needs the options index and cursor")
        self.columns, self.cursor = columns, options["cursor"]
        seed = options.get("seed")
        self.seed = None if seed in (None, "") else int(seed)
        self.epochs, self.skip = int(options.get("epochs", 1)), int(options.get("skip", 0))
        self.batch_tokens = int(options.get("batch_tokens", 0))
        self.waiting, self.most_waiting = options.get("waiting"), int(options.get("most_waiting", 0))
        system, path = _open(options["index"])
        slices = pq.read_table(path, filesystem=system).sort_by([("file", "ascending"), ("first", "ascending")]).to_pydict()
        self.slices = list(zip(slices["file"], slices["first"], slices["rows"], slices["tokens"], strict=True))
        self.total = sum(s[2] for s in self.slices)
        self.last: tuple[int, int] | None = None
        self.ordered: tuple[int, list[int]] = (-1, [])

    def _order(self, epoch: int) -> list[int]:
        if self.ordered[0] != epoch:
            n = len(self.slices)
            self.ordered = epoch, list(range(n)) if self.seed is None else np.random.default_rng([self.seed, epoch]).permutation(n).tolist()
        return self.ordered[1]

    def _normal(self, epoch: int, row: int) -> tuple[int, int]:
        while self.total and row >= self.total:
            epoch, row = epoch + 1, row - self.total
        return epoch, row

    def initialOffset(self) -> dict:
        epoch, row = self._normal(0, self.skip)
        return {"epoch": epoch, "row": row}

    def _known(self) -> tuple[int, int]:
        """Where the last batch ended."""
        if self.last is None:
            system, path = _open(self.cursor)
            try:
                with system.open_input_stream(path) as f:
                    found = json.loads(f.read())
            except FileNotFoundError:
                found = self.initialOffset()
            self.last = found["epoch"], found["row"]
        return self.last

    def _full(self) -> bool:
        """Whether as many batches as allowed have been written and not been marked as consumed."""
        if not self.waiting or not self.most_waiting:
            return False
        return len(unconsumed(self.waiting)) >= self.most_waiting

    def latestOffset(self) -> dict:
        epoch, row = self._known()
        tokens = 0
        while epoch < self.epochs and self.total and not self._full():
            at, before = 0, tokens
            for i in self._order(epoch):
                rows, n = self.slices[i][2:]
                if at + rows > row:
                    tokens += n * (at + rows - max(at, row)) // rows
                    if tokens >= self.batch_tokens > 0:
                        row = at + rows
                        break
                at += rows
            else:
                row = self.total
            epoch, row = self._normal(epoch, row)
            if not self.batch_tokens or tokens >= self.batch_tokens or tokens == before:
                break
        return {"epoch": epoch, "row": row}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        self.last = max(end["epoch"], 0), end["row"]
        system, path = _open(self.cursor)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path + ".new") as f:
            f.write(json.dumps(end).encode())
        system.move(path + ".new", path)
        out = []
        for epoch in range(start["epoch"], end["epoch"] + 1):
            begin, stop, at = start["row"] if epoch == start["epoch"] else 0, end["row"] if epoch == end["epoch"] else self.total, 0
            for i in self._order(epoch):
                file, first, rows, _ = self.slices[i]
                if at < stop and at + rows > begin:
                    out.append(Part(file, first, rows, max(begin - at, 0), min(stop - at, rows), epoch, max(at, begin)))
                at += rows
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        p = partition
        system, path = _open(p.file)
        with system.open_input_file(path) as f:
            whole, at, parts = pq.ParquetFile(f), 0, []
            for group in range(whole.num_row_groups):
                n = whole.metadata.row_group(group).num_rows
                if at < p.first + p.rows and at + n > p.first:
                    for batch in whole.iter_batches(SLICE_ROWS, row_groups=[group], columns=self.columns):
                        low, high = max(p.first - at, 0), min(p.first + p.rows - at, batch.num_rows)
                        if high > low:
                            parts.append(batch.slice(low, high - low))
                        at += batch.num_rows
                else:
                    at += n
        rows = pa.Table.from_batches(parts)
        order = np.arange(p.rows) if self.seed is None else np.random.default_rng([self.seed, p.epoch, p.first, hash_of(p.file)]).permutation(p.rows)
        rows = rows.select(self.columns).take(pa.array(order[p.begin : p.end]))
        rows = rows.append_column("epoch", pa.array(np.full(len(rows), p.epoch, np.int32))).append_column("place", pa.array(np.arange(p.place, p.place + len(rows))))
        yield from rows.to_batches()


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


class CorpusSource(DataSource):
    """Format `corpus`: the columns asked for by the schema, then epoch and place."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def streamReader(self, schema) -> CorpusReader:
        return CorpusReader(self.options, [f.name for f in schema.fields if f.name not in ("epoch", "place")])


def corpus_stream(
    spark: SparkSession, path: str, columns: Sequence[str], *, root: str, tokens: Column | None = None, batch_tokens: int | None = None, epochs: int = 1,
    seed: int | None = None, skip: int = 0, slice_rows: int = SLICE_ROWS, most_waiting: int | None = None,
) -> DataFrame:
    """A Parquet table as a stream of its columns, epoch (from 0) and place (in the epoch).

    root: a folder that driver and executors share, for the index (made where it is missing), the cursor,
    and, with most_waiting, the folders that the stream's batches are written to (see `flows.committed_once`):
    no batch begins while so many of them are not consumed yet.
    """
    index = f"{root}/index"
    system, hadoop = file_system(spark, f"{index}/_SUCCESS")
    if not system.exists(hadoop):
        write_index(spark, path, index, tokens=tokens, slice_rows=slice_rows)
    spark.dataSource.register(CorpusSource)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).select(*columns).schema.fields)
    reader = spark.readStream.format("corpus").schema(f"{schema}, epoch int, place long")
    options = {"index": index, "cursor": f"{root}/cursor.json", "epochs": epochs, "skip": skip, "seed": seed, "batch_tokens": batch_tokens}
    options |= {"waiting": f"{root}/batches", "most_waiting": most_waiting} if most_waiting else {}
    return reader.options(**{k: v for k, v in options.items() if v is not None}).load()


def unconsumed(folder: str) -> list[int]:
    """Numbers of the batches in a folder that nobody has marked as consumed, in order."""
    from pyarrow import fs

    system, path = _open(folder)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True))]
    done = {f.base_name for f in system.get_file_info(fs.FileSelector(f"{path}.consumed", allow_not_found=True))}
    found = {int(m[1]) for m in (re.fullmatch(r"batch_id=(\d+)", x) for x in names) if m}
    return sorted(n for n in found if str(n) not in done)


def consume(folder: str, number: int) -> None:
    """Marks a batch as consumed."""
    system, path = _open(f"{folder}.consumed")
    system.create_dir(path, recursive=True)
    system.open_output_stream(f"{path}/{number}").close()


def exhausted(stream: DataFrame, root: str, *, mode: str = "append", wait_s: float = 0.0) -> DataFrame:
    """Runs a stream, batch after batch, until it has nothing more; its rows of all batches, with batch_id.

    A root that was used before goes on from its checkpoint.  wait_s: how long nothing may come before
    that counts as the end, for a source that is held up by unconsumed batches.
    """
    from textmill.streaming.flows import committed_once

    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(committed_once(root)).outputMode(mode).trigger(processingTime="0 seconds")
    query = writer.option("checkpointLocation", f"{root}/checkpoint").start()
    try:
        until = time.monotonic() + wait_s
        while True:
            before = (query.lastProgress or {}).get("batchId")
            query.processAllAvailable()
            if (query.lastProgress or {}).get("batchId") != before:
                until = time.monotonic() + wait_s
            elif time.monotonic() >= until:
                break
            time.sleep(0.05)
    finally:
        query.stop()
    schema = spark.createDataFrame([], stream.schema).withColumn("batch_id", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).parquet(f"{root}/batches")
