"""Evaluation bookkeeping: metrics out of nested results, running losses, best checkpoints, due evaluations."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.functions.numbers import finite, is_metric, metric
from textmill.functions.text import step_number
from textmill.plans.ordered import WIDTH, Running, bucketed, running, running_max
from textmill.plans.shared import written


def _walk(value: object, names: tuple[str, ...] = (), places: tuple[int, ...] = ()) -> Iterator[tuple[tuple[str, ...], tuple[int, ...], str | None]]:
    """(names, places, scalar as text) of every entry, depth first; names and places lead to it, elements of lists have no name."""
    items = value.items() if isinstance(value, dict) else (("", v) for v in value) if isinstance(value, list) else ()
    for i, (k, v) in enumerate(items):
        nested = isinstance(v, (dict, list))
        yield (*names, str(k)), (*places, i), None if nested or isinstance(v, bool) or v is None else str(v)
        if nested:
            yield from _walk(v, (*names, str(k)), (*places, i))


class Entries:
    """Table function for SQL: all entries of a JSON text, one after the other.  Text that isn't JSON gives none."""

    def eval(self, text: str) -> Iterator[tuple]:
        for names, places, value in _entries(text):
            yield list(names), list(places), names[-1], value


def _entries(text: str | None) -> Iterator[tuple[tuple[str, ...], tuple[int, ...], str | None]]:
    try:
        found = json.loads(text or "null")
    except (ValueError, RecursionError):
        return
    yield from _walk(found)


ENTRIES = "names array<string>, places array<int>, name string, value string"
#: Entries in a batch that `flattened` gives.
BATCH_ENTRIES = 10_000


def register_entries(spark: SparkSession, name: str = "json_entries") -> None:
    """Makes the table function known to SQL: SELECT ... FROM t, LATERAL json_entries(payload)."""
    spark.udtf.register(name, F.udtf(Entries, returnType=ENTRIES, useArrow=True))


def flattened(df: DataFrame, *, key: str, payload: str) -> DataFrame:
    """key, names, places, name, value: all entries of a JSON column, given in batches of bounded size however many a payload has."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "names", "places", "name", "value"]
        for part in parts:
            kinds = [part.schema.field(0).type, pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.string()]
            rows: tuple[list, ...] = tuple([] for _ in names)
            for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for path, places, value in _entries(text):
                    for column, x in zip(rows, (k, path, places, path[-1], value), strict=True):
                        column.append(x)
                    if len(rows[0]) >= BATCH_ENTRIES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)
                        rows = tuple([] for _ in names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

    return df.select(key, payload).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {ENTRIES}")


def _visited(name: str, below: int) -> Column:
    """What orders entries as they are looked at: at each level an object's keys of the metric's name first, then by place; the first `below` levels by place alone."""
    order = F.zip_with("names", "places", lambda n, p: F.struct((~is_metric(n, name)).cast("int").alias("later"), p.alias("at")))
    if below:
        order = F.transform(order, lambda x, i: F.when(i < below, F.struct(F.lit(0).alias("later"), x["at"].alias("at"))).otherwise(x))
    return order


def named_metric(entries: DataFrame, name: str, *, key: str, below: int = 0) -> DataFrame:
    """The first finite value of a metric in each payload.

    An object's own keys count before what it holds, and so does what a key of that name holds; else by
    place.  The first `below` levels only tell where to look: they are taken by place.
    """
    order = _visited(name, below)
    good = entries.withColumn("score", metric("value")).filter(is_metric("name", name) & F.col("score").isNotNull() & (F.size("names") > below))
    return good.groupBy(key).agg(F.min_by("score", order).alias("score"))


def task_score(entries: DataFrame, task: str, name: str, *, key: str, anywhere: bool = False) -> DataFrame:
    """A metric below a top-level key that contains the task's name; with `anywhere`, else wherever it is."""
    own = named_metric(entries.filter(F.contains(F.lower(F.get("names", F.lit(0))), F.lit(task.lower()))), name, key=key, below=1)
    if not anywhere:
        return own
    rest = named_metric(entries, name, key=key).withColumnRenamed("score", "_any")
    return rest.join(own, key, "full").select(key, F.coalesce("score", "_any").alias("score"))


def task_scores(entries: DataFrame, tasks: list[str], name: str, *, key: str, primary: str, tie: str | None = None, tie_name: str | None = None) -> DataFrame:
    """key, task, score: each task's metric, null where it has none; only the primary task looks anywhere, the tie-break has a metric of its own.

    tasks: those of the configuration (see `text.task_names`); primary and tie-break are added if they are missing.
    """
    every = list(dict.fromkeys([*(t.lower() for t in tasks), primary.lower(), *([tie.lower()] if tie else [])]))
    wanted = {t: tie_name if tie and tie_name and t == tie.lower() else name for t in every}
    top = F.lower(F.get("names", F.lit(0)))
    score = metric("value")

    def first(n: str, below: int, here: Column) -> Column:
        return F.min_by(score, F.when(here & is_metric("name", n) & score.isNotNull() & (F.size("names") > below), _visited(n, below)))

    # one aggregate a task, and one for the primary task's look anywhere, over one pass
    found = {t: first(n, 1, F.contains(top, F.lit(t))).alias(f"_{i}") for i, (t, n) in enumerate(wanted.items())}
    by = entries.groupBy(key).agg(*found.values(), first(name, 0, F.lit(True)).alias("_any"))
    rows = [F.struct(F.lit(t).alias("task"), (F.coalesce(F.col(f"_{i}"), F.col("_any")) if t == primary.lower() else F.col(f"_{i}")).alias("score")) for i, t in enumerate(every)]
    return by.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.task", "x.score")


def loss_by_mode(rows: DataFrame, modes: DataFrame, *, mode: str, loss: str, empty: float = 0.0) -> DataFrame:
    """Sum, count and mean of each mode, partial and final; modes without rows stay, with the empty value."""
    sums = rows.groupBy(mode).agg(F.sum(loss).alias("total"), F.count(loss).alias("n"))
    return modes.join(sums, mode, "left").select(mode, F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.col("total") / F.col("n"), F.lit(empty)).alias("mean"))


def masked_mean(values: Column, mask: Column) -> Column:
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m, v).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return total / F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def combined_mean(mean: Column, n: Column) -> Column:
    return F.sum(mean * n) / F.sum(n)


def ema(values: Column, alpha: float = 0.1) -> Column:
    """The running exponential mean of an ordered array, as an array: the first value seeds it.

    Each mean is taken from the last `span` values and the seed's rest, whose weight has then vanished
    below a double's precision, so the work is linear in the array.
    """
    span = math.ceil(math.log(2.0**-60) / math.log(1 - alpha)) if 0 < alpha < 1 else 1
    fold = lambda part: F.aggregate(F.slice(part, 2, F.size(part)), F.get(part, F.lit(0)), lambda a, x: (1 - alpha) * a + alpha * x)
    return F.transform(values, lambda _, i: fold(F.slice(values, F.greatest(i - span, F.lit(0)) + 1, F.least(i, F.lit(span)) + 1)))


def ema_rows(rows: DataFrame, *, run: str, order: str, value: str, alpha: float = 0.1, width: int = WIDTH) -> DataFrame:
    """Adds `ema` and its running minimum `least`, in two phases, so that no run has to be in one task.

    Over a bucket of a run's steps the mean is linear in what it is before: after n values it is that
    times (1 - alpha) ** n plus what the bucket adds.  Buckets are summed up first; a run's few sums give
    each bucket's start; then each bucket is folded by itself.  The order is a number; null values keep the mean.
    """
    kind = dict(rows.dtypes)
    own = rows.select(run, order, F.col(value).cast("double").alias(value), F.floor(F.col(order) / width).alias("_bucket"))
    last = W.partitionBy(run, "_bucket").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    later = F.coalesce(F.count(value).over(last), F.lit(0))
    added = own.withColumn("_add", alpha * F.pow(F.lit(1 - alpha), later) * F.col(value))
    sums = added.groupBy(run, "_bucket").agg(F.count(value).alias("n"), F.coalesce(F.sum("_add"), F.lit(0.0)).alias("add"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("first"))

    def starts(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, mean, out = part.sort_values("_bucket"), None, []
        for n, add, first in zip(part["n"], part["add"], part["first"], strict=True):
            out.append(mean)
            if n:  # the first value seeds the mean, and then counts as any other
                mean = (1 - alpha) ** n * (first if mean is None else mean) + add
        return pd.DataFrame({run: [key[0]] * len(part), "_bucket": part["_bucket"], "_start": out})

    begun = sums.groupBy(run).applyInPandas(starts, f"{run} {kind[run]}, _bucket long, _start double")

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mean = None, None
        for part in parts:
            means = []
            for k, b, x, start in zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if (k, b) != at:
                    at, mean = (k, b), start
                mean = mean if x is None else x if mean is None else (1 - alpha) * mean + alpha * x
                means.append(mean)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(means, pa.float64())], names=[run, order, value, "ema"])

    joined = own.join(begun, own[run].eqNullSafe(begun[run]) & (own["_bucket"] == begun["_bucket"])).select(own[run], own["_bucket"], order, value, "_start")
    ordered = joined.repartition(run, "_bucket").sortWithinPartitions(run, "_bucket", order)
    out = ordered.mapInArrow(fold, f"{run} {kind[run]}, {order} {kind[order]}, {value} double, ema double").withColumn("_bucket", F.floor(F.col(order) / width))
    lows = out.groupBy(F.col(run).alias("_run"), F.col("_bucket").alias("_of")).agg(F.min("ema").alias("_low"))
    lows = lows.withColumn("_low", F.min("_low").over(W.partitionBy("_run").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)))
    within = F.min("ema").over(W.partitionBy(run, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("_within", within).join(lows, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_bucket") == F.col("_of")))
    return out.select(run, order, value, "ema", F.least("_within", "_low").alias("least"))


#: Scores closer than this are equal.
BAND = 1e-12


def _raised(rows: DataFrame, keys: list[str], order: str, value: Column, into: str) -> DataFrame:
    """Adds `into`: whether a row's value beats the best one before it by more than the band, and so becomes the best.

    Only a row above every row before can do so, and it surely does if it is above them by more than the
    band; what lies between depends on no row but the few before it that are as close, back to the last
    sure one.  So the scan is a running maximum, and only rows within the band above that are folded.
    """
    seen = running(rows.withColumn("_value", value), keys, order, {"_before": running_max(F.col("_value"))})
    above = F.col("_value").isNotNull() & (F.col("_before").isNull() | (F.col("_value") > F.col("_before")))
    sure = F.col("_value").isNotNull() & (F.col("_before").isNull() | (F.col("_value") > F.col("_before") + BAND))
    seen = written(seen.withColumns({"_above": above, "_sure": sure}), "scores")
    seen = written(running(seen, keys, order, {"_last": running_max(F.when(F.col("_sure"), F.col("_value")))}, inclusive=True), "scores")

    def fold(part: pa.Table) -> pa.Table:
        part = part.sort_by("_order")
        best, raised = part.column("_last")[0].as_py(), []
        for v in part.column("_value").to_pylist():
            raised.append(v > best + BAND)
            best = v if raised[-1] else best
        return part.select(["_row"]).filter(pa.array(raised))

    row = F.struct(*keys, order).alias("_row")
    close = seen.filter(F.col("_above") & ~F.col("_sure")).select(row, F.struct(*keys).alias("_keys"), F.col(order).alias("_order"), "_last", "_value")
    kind = close.schema["_row"].dataType.simpleString()
    found = close.groupBy("_keys", "_last").applyInArrow(fold, f"_row {kind}").withColumn("_close", F.lit(True))
    out = seen.withColumn("_row", F.struct(*keys, order)).join(found, "_row", "left").withColumn(into, F.col("_sure") | F.coalesce("_close", F.lit(False)))
    return out.drop("_row", "_close", "_value", "_before", "_above", "_sure", "_last")


def running_best(rows: DataFrame, *, run: str, order: str, primary: str, tie: str | None = None) -> DataFrame:
    """Adds what an evaluation loop would hold after each row: improved, best, best_order (the first row with that score).

    With `tie`, also tie_improved, best_tie and best_tie_order: the best tie-break score among the rows
    whose primary score equals the best one, counted anew whenever that improves; a missing tie-break
    score changes nothing, a missing or infinite primary score neither.  Scores within 1e-12 are equal.
    No run has to be in one task.
    """
    score = finite(F.col(primary))
    out = written(_raised(bucketed(rows, order), [run], order, score, "improved"), "scores")
    what = {"best": running_max(F.when(F.col("improved"), score)), "best_order": running_max(F.when(F.col("improved"), F.col(order)))}
    out = running(out, [run], order, what, inclusive=True)
    if tie is not None:
        # a better primary score opens an epoch of its own
        second, keys = finite(F.col(tie)), [run, "best_order"]
        tied = F.when(F.abs(score - F.col("best")) <= BAND, second)
        out = written(_raised(written(out, "scores"), keys, order, tied, "tie_improved"), "scores")
        what = {"best_tie": running_max(F.when(F.col("tie_improved"), second)), "best_tie_order": running_max(F.when(F.col("tie_improved"), F.col(order)))}
        out = running(out, keys, order, what, inclusive=True)
    return out.drop("_coarse", "_fine")


def best_so_far(rows: DataFrame, *, run: str, order: str, primary: str, tie: str) -> DataFrame:
    """The best row of each run: of those with the best primary score the one with the best tie-break, or the first where none has one."""
    names = rows.columns
    scanned = running_best(rows, run=run, order=order, primary=primary, tie=tie).filter("improved OR tie_improved")
    last = F.struct("best_order", "best_tie_order")  # epochs grow, and within one the winners' orders do
    return scanned.groupBy(run).agg(F.max_by(F.struct(*names), last).alias("_r")).select("_r.*")


def latest_events(events: DataFrame, *, kind: str, order: str, priority: list[str]) -> DataFrame:
    """The last row of each kind, with its priority (the first kind named first)."""
    last = events.groupBy(kind).agg(F.max_by(F.struct(*events.columns), F.struct(order)).alias("e")).select("e.*")
    rank = F.array_position(F.array(*(F.lit(x) for x in priority)), F.col(kind))
    return last.withColumn("priority", F.when(rank > 0, rank))


def longest_failures(rows: DataFrame, *, run: str, order: str, failed: Column) -> DataFrame:
    """The longest stretch of consecutive failures of each run, by gaps and islands: a stretch is the failures after the same number of successes, and is summed before it is shuffled."""
    success = (~F.col("_f")).cast("long")
    marked = running(rows.select(run, order, F.coalesce(failed, F.lit(False)).alias("_f")), [run], order, {"_island": Running(success)}, inclusive=True)
    lengths = marked.groupBy(run, "_island").agg(F.sum(F.col("_f").cast("long")).alias("n"))
    return lengths.groupBy(run).agg(F.max("n").alias("longest"))


def ranked_files(files: DataFrame, preferred: str, *, model: str | None = None) -> DataFrame:
    """Candidate files of a model (a handful): the preferred name first, then .safetensors, then by name; adds `place`.  model: the column that tells models apart."""
    order = W.partitionBy(*([model] if model else [])).orderBy((F.col("name") == preferred).desc(), F.col("name").endswith(".safetensors").desc(), "name")
    return files.withColumn("place", F.row_number().over(order))


def newest_result(files: DataFrame, *, name: str = "name") -> DataFrame:
    """The result file of the highest step, by the number in its name; files without one are none."""
    return files.withColumn("step", step_number(name)).filter(F.col("step").isNotNull() & F.col(name).rlike(r"^eval_results_step_\d+.*\.json$")).orderBy(F.desc("step"), name).limit(1)


def newest_checkpoint(files: DataFrame, *, name: str = "name", final: str | None = "final") -> DataFrame:
    """The checkpoint to resume from: the named final one where there is one, else that of the highest step."""
    known = files.withColumn("step", step_number(name)).filter((F.col(name) == final if final else F.lit(False)) | F.col("step").isNotNull())
    first = F.col(name) == final if final else F.lit(False)
    return known.orderBy(first.desc(), F.col("step").desc_nulls_last(), name).limit(1)


def validation_mean(batches: DataFrame, first: int, *, order: str, loss: str) -> DataFrame:
    """The mean loss of the first batches (a top-k report)."""
    return batches.orderBy(order).limit(first).agg(F.avg(loss).alias("mean"), F.count("*").alias("n"))


def key_names(rows: DataFrame, column: str) -> DataFrame:
    """All keys of a map column, sorted; for diagnostics of sources that give no document."""
    return rows.select(F.explode(F.map_keys(column)).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("names"))


def passed_by_position(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Pairs candidates with references by task number and counts those that pass: task_no, n, passed."""
    joined = candidates.join(references, "task_no")
    return joined.groupBy("task_no").agg(F.count("*").alias("n"), F.count_if(F.col("text") == F.col("expected")).alias("passed"))


def same_keys(a: Column, b: Column) -> Column:
    """Whether two maps have the same keys."""
    return (F.size(F.array_except(F.map_keys(a), F.map_keys(b))) == 0) & (F.size(F.array_except(F.map_keys(b), F.map_keys(a))) == 0)
