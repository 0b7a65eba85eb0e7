"""The mixture: categories' shares, sources' token targets, joins with prior cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def targets(sources: DataFrame, mix: DataFrame, tokens: int) -> DataFrame:
    """sources (source_id, category, weight) with their token targets.

    mix: category, fraction.  Both divisions truncate; a category without sources loses its tokens,
    a source without a share gets none.
    """
    share = F.floor(F.lit(tokens) * F.col("fraction"))
    all_ = F.sum("weight").over(W.partitionBy("category"))
    return sources.join(F.broadcast(mix), "category").withColumn("target", F.floor(share * F.col("weight") / all_).cast("long"))


def with_cursor(sources: DataFrame, cursor: DataFrame) -> DataFrame:
    """Adds epoch and offset of each source, 0 where there is none yet."""
    zero = F.lit(0).cast("long")
    return sources.join(cursor, "source_id", "left").withColumns({"epoch": F.coalesce("epoch", zero), "offset": F.coalesce("offset", zero)})


def reset_barren(cursor: DataFrame, stats: DataFrame) -> DataFrame:
    """Cursors of flagged sources that consumed examples without a token over all shards start a new epoch.

    cursor: source_id, epoch, offset, reset_zero_token (flag); stats: source_id, tokens, examples.
    """
    sums = stats.groupBy("source_id").agg(F.sum("tokens").alias("_t"), F.sum("examples").alias("_e"))
    barren = F.coalesce(F.col("reset_zero_token") & (F.col("_t") == 0) & (F.col("_e") > 0), F.lit(False))
    return cursor.join(sums, "source_id", "left").select("source_id", F.when(barren, F.col("epoch") + 1).otherwise(F.col("epoch")).alias("epoch"), F.when(barren, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"), barren.alias("was_reset"))


def never_used(sources: DataFrame, stats: DataFrame) -> DataFrame:
    return sources.join(stats.select("source_id").distinct(), "source_id", "left_anti")
