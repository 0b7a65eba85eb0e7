"""Token budgets: which documents of each source a shard takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.plans.ordered import WIDTH, running_sum


def take(docs: DataFrame, targets: DataFrame, *, tokens: str = "n_tokens", order: str = "seq", width: int = WIDTH) -> DataFrame:
    """Documents of each source while the tokens before them are below the source's target; the one that crosses it is in.

    docs: source_id, order, tokens; targets: source_id, target.  Adds `before` and `target`.
    """
    known = docs.join(F.broadcast(targets.select("source_id", "target")), "source_id")
    summed = running_sum(known, ["source_id"], order, F.col(tokens), "before", width=width)
    return summed.filter(F.col("before") < F.col("target"))


def cycle(docs: DataFrame, targets: DataFrame, *, tokens: str = "n_tokens", order: str = "seq", epochs: int = 16, width: int = WIDTH) -> DataFrame:
    """As `take`, over a source's documents again and again, up to `epochs` times.

    A source's total tells how often each document is taken without writing any pass out: document d
    with b tokens before it is in pass e if e * total + b is below the target.  Adds `passes`.
    """
    totals = docs.groupBy("source_id").agg(F.sum(tokens).alias("total"))
    known = docs.join(F.broadcast(targets.select("source_id", "target")), "source_id").join(F.broadcast(totals), "source_id")
    summed = running_sum(known, ["source_id"], order, F.col(tokens), "before", width=width)
    passes = F.when(F.col("total") <= 0, F.least(F.lit(epochs), F.signum("target").cast("int"))).otherwise(F.least(F.lit(epochs), F.ceil((F.col("target") - F.col("before")) / F.col("total"))))
    return summed.withColumn("passes", F.greatest(passes, F.lit(0)).cast("int")).filter("passes > 0")


def progress_marks(taken: DataFrame, interval: int, *, tokens: str = "n_tokens") -> DataFrame:
    """The rows at which a source reports: its first, and those that reach another multiple of the interval.  taken: with `before`."""
    now = F.floor((F.col("before") + F.col(tokens)) / interval)
    return taken.filter((F.col("before") == 0) | (now != F.floor(F.col("before") / interval)))


def staged(files: DataFrame, target: int) -> DataFrame:
    """Files to read for a target, in order, by the tokens that a file listing records: those before which less than the target is read."""
    summed = running_sum(files, [], "file_no", F.col("n_tokens"), "before")
    return summed.filter(F.col("before") < target)


def shard_stats(taken: DataFrame, *, tokens: str = "n_tokens", by: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Tokens and documents by source (or other keys), with the target where it is known."""
    extra = [F.max("target").alias("target_tokens")] if "target" in taken.columns else []
    return taken.groupBy(*by).agg(F.sum(tokens).alias("actual_tokens"), F.count("*").alias("documents"), *extra)


def mode_stats(samples: DataFrame, *, tokens: str = "n_tokens") -> DataFrame:
    """Tokens, samples and files of each mode.  samples: mode, part, tokens (see `manifest.write_shard`)."""
    return samples.groupBy("mode").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("samples"), F.countDistinct("part").alias("files"))


def source_stats(docs: DataFrame, taken: DataFrame, cursor: DataFrame, retries: DataFrame | None = None, *, tokens: str = "n_tokens") -> DataFrame:
    """What a shard took from each source, and where the source stands now.

    docs: source_id, a row for every example; taken: what `cycle` gives of them, with target; cursor:
    source_id, epoch, offset before the shard; retries: source_id, stream_retries.  An example counts
    each time that it is passed; a pass over all of them completes an epoch.
    """
    sizes = docs.groupBy("source_id").agg(F.count("*").alias("rows"))
    sums = taken.groupBy("source_id").agg(F.max("target").alias("target_tokens"), F.sum(F.col(tokens) * F.col("passes")).alias("actual_tokens"), F.sum(F.when(F.col(tokens) > 0, F.col("passes")).otherwise(0)).cast("long").alias("documents"), F.sum("passes").alias("examples_consumed"))
    out = sums.join(sizes, "source_id").join(cursor.select("source_id", F.col("epoch").alias("_e"), F.col("offset").alias("_o")), "source_id", "left")
    at = F.coalesce("_o", F.lit(0)) + F.col("examples_consumed")
    out = out.withColumns({"epochs_completed": F.floor(at / F.col("rows")), "offset": at % F.col("rows")}).withColumn("epoch", F.coalesce("_e", F.lit(0)) + F.col("epochs_completed"))
    out = out.join(retries, "source_id", "left") if retries is not None else out.withColumn("stream_retries", F.lit(0).cast("long"))
    return out.withColumn("stream_retries", F.coalesce("stream_retries", F.lit(0))).drop("rows", "_e", "_o")


def limited(rows: DataFrame, most: int | None, *, order: str) -> DataFrame:
    """The first `most` rows in order; all of them without a limit."""
    return rows if most is None else rows.orderBy(order).limit(most)


def conserved(shards: DataFrame, prepared: Column) -> DataFrame:
    """One row: whether spans are contiguous and add up to what was prepared.  shards: id, actual_tokens, tokens_start, tokens_end (one row a shard)."""
    # contiguous spans begin where all shards before them add up to, but for where the first begins
    summed = running_sum(shards, [], "id", F.col("actual_tokens"), "_before").withColumn("_shift", F.col("tokens_start") - F.col("_before"))
    whole = F.bool_and(F.col("tokens_end") - F.col("tokens_start") == F.col("actual_tokens"))
    out = summed.agg((whole & (F.min("_shift") == F.max("_shift"))).alias("contiguous"), F.sum("actual_tokens").alias("total"))
    return out.withColumn("conserved", F.col("total") == prepared)
