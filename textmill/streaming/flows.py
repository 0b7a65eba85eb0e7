"""Structured Streaming: budgeted admission of documents, running losses, exactly-once shard commits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textmill.plans.shared import scratch
from textmill.sources.readers import Source


def _folded(fold: Callable[[tuple, pd.DataFrame], tuple[tuple, dict]], start: tuple):
    """A function for applyInPandasWithState: a batch's rows of a key, in order, go through `fold` at once, which returns the new state and columns."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values("order", kind="stable", ignore_index=True)
        now, columns = fold(state.get if state.exists else start, rows)
        state.update(now)
        yield pd.DataFrame({"key": [key[0]] * len(rows), "order": rows["order"], **columns})

    return run


def ema_stream(events: DataFrame, *, run: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """key, order, ema of a stream of values for each run; state is one number a run.  Steps that come after later ones are folded when they come."""

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, dict]:
        known = [] if pd.isna(state[0]) else [state[0]]
        means = pd.Series([*known, *rows["value"]]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(known) :]
        return (float(means[-1]),), {"ema": means}

    rows = events.select(F.col(run).alias("key"), F.col(order).cast("long").alias("order"), F.col(value).cast("double").alias("value")).filter("value IS NOT NULL")
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandasWithState(_folded(fold, (float("nan"),)), f"key {kind}, order long, ema double", "ema double", "append", GroupStateTimeout.NoTimeout)


def admitted_stream(docs: DataFrame, target: int, *, source: str, order: str, tokens: str) -> DataFrame:
    """key, order, before, admitted: which documents of a stream each source's budget admits; state is a source's tokens so far."""

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, dict]:
        sizes = rows["value"].fillna(0).to_numpy(np.int64)
        before = int(state[0]) + np.cumsum(sizes) - sizes
        # from the first document that isn't admitted on, nothing is added
        full = np.flatnonzero(before >= target)
        if len(full):
            before[full[0] :] = before[full[0]]
        admitted = before < target
        return (int(before[-1] + (sizes[-1] if admitted[-1] else 0)),), {"before": before, "admitted": admitted}

    rows = docs.select(F.col(source).alias("key"), F.col(order).cast("long").alias("order"), F.col(tokens).cast("long").alias("value"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandasWithState(_folded(fold, (0,)), f"key {kind}, order long, before long, admitted boolean", "before long", "append", GroupStateTimeout.NoTimeout)


def totals_stream(docs: DataFrame, *, source: str, tokens: str) -> DataFrame:
    """Tokens and documents of each source so far, by the engine's own aggregation state."""
    return docs.groupBy(source).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("documents"))


def committed_once(root: str, name: str = "batches") -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: a batch's rows go into a folder of its number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/{name}")

    return write


def drained(stream: DataFrame, mode: str = "append", root: str | None = None, keep_batch: bool = False) -> DataFrame:
    """All that a stream gives now, written batch by batch and read from the files; in complete mode, the last batch.

    Batches and checkpoint are under `root`; without one, in a new folder of the one that driver and
    executors share.  A root that was used before goes on where it stopped.
    """
    spark = stream.sparkSession
    if root is None:
        root = scratch(spark, "stream")
    spark.createDataFrame([], stream.schema).withColumn("batch_id", F.lit(-1)).write.mode("append").partitionBy("batch_id").parquet(f"{root}/batches")
    writer = stream.writeStream.foreachBatch(committed_once(root)).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{root}/checkpoint").start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    out = spark.read.schema(schema).parquet(f"{root}/batches")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("batch_id").alias("batch_id"))), "batch_id", "left_semi")
    return out if keep_batch else out.drop("batch_id")


class Unreadable(RuntimeError):
    """A source kept failing."""


def retried(start: Callable[[], object], *, most: int = 5, base_s: float = 1.0, longest_s: float = 60.0, wait: Callable[[float], None] = time.sleep) -> int:
    """Runs a stream until it ends, and starts it again from its checkpoint when it fails, with growing waits; returns the number of retries.

    start: starts the query and returns it.  A query that got on before it failed begins the count anew.
    """
    failures = retries = 0
    last = -1
    while True:
        query = start()
        try:
            query.awaitTermination()
            return retries
        except StreamingQueryException as error:
            batch = (query.lastProgress or {}).get("batchId", -1)
            failures = 1 if batch > last else failures + 1
            last, retries = max(last, batch), retries + 1
            if failures > most:
                raise Unreadable(f"{failures} failures without progress") from error
            wait(min(longest_s, base_s * 2.0 ** (failures - 1)))


def source_stream(spark: SparkSession, source: Source, schema: str, *, files_ahead: int = 1) -> DataFrame:
    """A source's files as a stream: at most `files_ahead` files a batch, so that no more is read ahead than that.

    The checkpoint of the query that reads it is the source's cursor: it resumes after the last committed
    file.  A source that is looped has a checkpoint for each epoch.
    """
    if source.path is None:
        raise ValueError(f"source {source.source_id} has no path")
    reader = spark.readStream.format(source.format).schema(schema).options(**source.options).option("maxFilesPerTrigger", files_ahead)
    return reader.load(source.path)


def counted_windows(events: DataFrame, *, at: str, kind: str, size: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Extension: events of each kind by window, tumbling or, with `slide`, sliding, with a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, *, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: each key's sessions, stretches of events less than `gap` apart: key, start, end (gap included), n.  In append mode a session comes when the watermark has passed its end; rows later than that are dropped and counted in the query's progress."""
    by = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def paired(first: DataFrame, second: DataFrame, *, key: str, at: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: rows of two streams with one key, the second at most `within` after the first.  Both have a watermark, so state is bounded by the interval.

    Columns of the first as they are, those of the second with `next_` before their names.
    """
    one = first.withWatermark(at, late)
    two = second.select(*(F.col(c).alias(f"next_{c}") for c in second.columns)).withWatermark(f"next_{at}", late)
    near = (F.col(f"next_{at}") >= F.col(at)) & (F.col(f"next_{at}") <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return one.join(two, (F.col(key) == F.col(f"next_{key}")) & near)


def json_log(spark: SparkSession, path: str, schema: str, *, files_ahead: int = 100) -> DataFrame:
    """A folder of JSON lines files that grows, as a stream; damaged lines are left out."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_ahead).json(path)


def latest_stream(events: DataFrame, *, kind: str, order: str) -> DataFrame:
    """The last event of each kind, in update mode: a batch gives the kinds that have a new last one or more events.

    State is one event a kind; an event that comes again, or after later ones, changes nothing.
    """
    return events.groupBy(kind).agg(F.max_by(F.struct(*events.columns), F.struct(order)).alias("e")).select("e.*")


def upserted(stream: DataFrame, root: str, key: str) -> DataFrame:
    """All that a stream in update mode gives now, its last row of each key; the files keep a row for each update."""
    rows = drained(stream, "update", root, keep_batch=True)
    return rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch_id").alias("r")).select("r.*")


class Stalled(RuntimeError):
    """A stream made no progress for too long."""


def await_progress(query, longest_s: float = 300.0, poll_s: float = 1.0) -> None:
    """Waits for a query to end; Stalled if it handles no row for longest_s."""
    last, since = -1, time.monotonic()
    while query.isActive:
        if query.awaitTermination(poll_s):
            return
        progress = query.lastProgress
        batch = progress["batchId"] if progress and progress["numInputRows"] else last
        if batch != last:
            last, since = batch, time.monotonic()
        elif time.monotonic() - since > longest_s:
            query.stop()
            raise Stalled(f"no row for {longest_s} s")
