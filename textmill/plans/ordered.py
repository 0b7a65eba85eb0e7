"""Ordered operators that never put a whole key, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that a bucket of the order column has, about.
WIDTH = 8192
#: Coarse buckets in a factor of two of the order column's size: some 2,000 in all, whatever the data are.
OCTAVE = 16
#: Fine buckets in a coarse one, at most; beyond WIDTH times as many rows, buckets get larger.
MOST_FINE = 1 << 16


def _coarse(order: Column) -> Column:
    """A number that grows with the order, by its logarithm; below all others for null."""
    size = F.floor(F.log2(F.abs(order) + 1) * OCTAVE).cast("int")
    return F.when(order.isNull(), F.lit(-(1 << 20))).otherwise(F.when(order < 0, -size).otherwise(size))


def bucketed(df: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    """Adds `_coarse` and `_fine`, which together grow with a numeric order column, some `width` rows to each pair.

    Coarse buckets are logarithmic, so they need no look at the data; each is then cut evenly between its
    own least and greatest value into as many fine ones as its rows ask for.  Dense ids, ids spread over
    the whole range of a long and clusters far from zero all come out even; the table of coarse buckets,
    which is broadcast, has a few thousand rows whatever the input.  Equal orders share a bucket.
    """
    at = F.col(order).cast("double")
    coarse = df.select(at.alias("_at")).groupBy(_coarse(F.col("_at")).alias("_of")).agg(F.min("_at").alias("_low"), (F.max("_at") - F.min("_at")).alias("_span"), F.count("*").alias("_n"))
    parts = F.least(F.ceil(F.col("_n") / width), F.lit(MOST_FINE))
    coarse = coarse.select("_of", "_low", (parts / F.when(F.col("_span") > 0, F.col("_span"))).alias("_scale"), (parts - 1).alias("_last"))
    joined = df.withColumn("_coarse", _coarse(at)).join(F.broadcast(coarse), F.col("_coarse") == F.col("_of"))
    fine = F.least(F.floor((at - F.col("_low")) * F.coalesce("_scale", F.lit(0.0))), F.col("_last"))
    return joined.withColumn("_fine", F.coalesce(fine, F.lit(0)).cast("int")).drop("_of", "_low", "_scale", "_last")


@dataclass(frozen=True)
class Running:
    """What runs along an order: an aggregate of a value, and how two parts' aggregates make one."""

    value: Column
    of: Callable[[Column], Column] = F.sum
    both: Callable[[Column, Column], Column] = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def running_max(value: Column) -> Running:
    return Running(value, F.max, F.greatest)


def running_min(value: Column) -> Running:
    return Running(value, F.min, F.least)


def running(df: DataFrame, keys: Sequence[str], order: str, what: Mapping[str, Running], *, inclusive: bool = False, width: int = WIDTH) -> DataFrame:
    """Adds aggregates over the rows of the same keys that come before (with `inclusive`, and the row itself), in two phases.

    Buckets of the order column are aggregated first (combined before the shuffle); a window over these,
    one row for some `width` of a key's, gives what comes before each bucket; rows are then aggregated
    within their bucket.  No task holds more rows than a bucket, or than a key has buckets.  Rows that tie in `order` are taken in no
    stated order; make it unique.  Null keys and a null order are values like others (a null order comes
    first).  Maxima, minima and the like are null where nothing came before.

    A table that `bucketed` has been over keeps its buckets.  df is read several times, so a table that
    has run through this is better written before it does again.
    """
    again = "_fine" in df.columns
    kept = (df if again else bucketed(df, order, width)).withColumns({f"_value{i}": r.value for i, r in enumerate(what.values())})
    own, n = [*keys, "_coarse", "_fine"], len(what)
    sums = kept.groupBy(*own).agg(*(r.of(f"_value{i}").alias(f"_sum{i}") for i, r in enumerate(what.values())))
    before = W.partitionBy(*keys).orderBy("_coarse", "_fine").rowsBetween(W.unboundedPreceding, -1)
    # a struct equals another one with nulls at the same places, and is a key that the join and the window share
    starts = sums.select(F.struct(*own).alias("_bucket"), *(r.of(f"_sum{i}").over(before).alias(f"_start{i}") for i, r in enumerate(what.values())))
    within = W.partitionBy("_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    rows = kept.withColumn("_bucket", F.struct(*own)).join(starts, "_bucket")
    rows = rows.withColumns({name: r.both(F.col(f"_start{i}"), r.of(f"_value{i}").over(within)) for i, (name, r) in enumerate(what.items())})
    return rows.drop("_bucket", *(() if again else ("_coarse", "_fine")), *(f"{c}{i}" for c in ("_value", "_start") for i in range(n)))


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, into: str, *, width: int = WIDTH) -> DataFrame:
    """Adds the sum of `value` over the rows of the same keys that come before."""
    return running(df, keys, order, {into: Running(value)}, width=width)


def row_numbers(df: DataFrame, order: str, into: str, *, keys: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Adds each row's 0-based place in the order."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), into, width=width)


def hash_rank(df: DataFrame, key: Column, into: str, *, slices: int = 4096) -> DataFrame:
    """Adds each row's 0-based place in the order of a hexadecimal key (a shuffle by hash), in two phases over the key's first digits."""
    kept = df.withColumn("_key", key).withColumn("_slice", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("long") * slices / 65536))
    counts = kept.groupBy("_slice").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return kept.join(F.broadcast(starts), "_slice").withColumn(into, F.col("_start") + F.row_number().over(W.partitionBy("_slice").orderBy("_key")) - 1).drop("_key", "_slice", "_start")
