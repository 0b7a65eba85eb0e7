"""Token sequences into fixed windows, parts, ranks' ranges and micro-batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textmill.plans.ordered import WIDTH, Running, hash_rank, row_numbers, running, running_sum
from textmill.plans.shared import drop, written


def windows(docs: DataFrame, length: int, *, key: str, order: str, tokens: str = "tokens", width: int = WIDTH) -> DataFrame:
    """Concatenates each key's documents in order and cuts every `length` tokens; the remainder is dropped.

    A document is sent to the windows it overlaps by arithmetic on its span, so this is an explode and
    a group-by, not a join of ranges.  Returns key, window, input_ids, positions (from 0 in each document).
    """
    kept = docs.filter(F.size(tokens) > 0)
    spans = running_sum(kept, [key], order, F.size(tokens).cast("long"), "_at", width=width).withColumn("_end", F.col("_at") + F.size(tokens))
    parts = spans.withColumn("window", F.explode(F.sequence(F.floor(F.col("_at") / length), F.floor((F.col("_end") - 1) / length))))
    begin = F.greatest(F.col("window") * length - F.col("_at"), F.lit(0)).cast("int")
    stop = F.least((F.col("window") + 1) * length - F.col("_at"), F.size(tokens)).cast("int")
    parts = parts.select(key, "window", F.struct(F.col("_at").alias("s"), F.slice(tokens, begin + 1, stop - begin).alias("t"), F.sequence(begin, stop - 1).alias("p")).alias("x"))
    whole = parts.groupBy(key, "window").agg(F.array_sort(F.collect_list("x")).alias("x"))
    whole = whole.select(key, "window", F.flatten(F.transform("x", lambda x: x["t"])).alias("input_ids"), F.flatten(F.transform("x", lambda x: x["p"])).alias("positions"))
    return whole.filter(F.size("input_ids") == length)


def segment_ids(positions: Column) -> Column:
    """How many documents have begun up to each token of a window."""
    begun = F.filter(F.transform(positions, lambda p, i: F.when(p == 0, i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(0)), begun, F.array(F.size(positions)))
    return F.flatten(F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda e, k: F.array_repeat(k, F.get(edges, k + 1) - e)))


def segments(rows: DataFrame, *, sample: str, place: str, position: str) -> DataFrame:
    """Adds `segment` to exploded tokens: the running count of documents' first tokens."""
    return rows.withColumn("segment", F.sum((F.col(position) == 0).cast("int")).over(W.partitionBy(sample).orderBy(place)))


def attention_pairs(rows: DataFrame, *, sample: str, place: str) -> DataFrame:
    """Query and key places that a causal mask within documents lets through.  Quadratic in a document's part of a window, so in the window's length at most."""
    q = rows.select(sample, "segment", F.col(place).alias("q"))
    k = rows.select(sample, "segment", F.col(place).alias("k"))
    return q.join(k, [sample, "segment"]).filter("k <= q")


def pair_counts(spans: DataFrame, length: int, *, key: str, begin: str, tokens: str) -> DataFrame:
    """key, window, segments, pairs: how many pairs `attention_pairs` would give, from the documents' spans alone: a part of n tokens has n (n + 1) / 2."""
    end, at = F.col(begin) + F.col(tokens), F.col("window") * length
    parts = spans.withColumn("window", F.explode(F.sequence(F.floor(F.col(begin) / length), F.floor((end - 1) / length))))
    n = F.least(end, at + length) - F.greatest(F.col(begin), at)
    return parts.withColumn("_n", n).groupBy(key, "window").agg(F.count("*").alias("segments"), F.sum((F.col("_n") * (F.col("_n") + 1) / 2).cast("long")).alias("pairs"))


def loss_mask(positions: Column) -> Column:
    """Whether each token's successor is of the same document."""
    return F.transform(F.slice(positions, 2, F.size(positions) - 1), lambda p: p != 0)


def shift(ids: Column) -> tuple[Column, Column]:
    """Inputs and next-token targets."""
    return F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids) - 1)


#: Parts that one task rolls together, about.
TOGETHER = 64


def _next_starts(at: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """For rows that follow each other gaplessly: the place of the row that would open the next part if a part began at each; their number where none would."""
    found = np.searchsorted(at, at + most, side="right") - 1
    # that row holds the first token too many; a row too long for any part is followed by its successor
    found = np.where(end[found] > at + most, np.maximum(found, np.arange(len(at)) + 1), len(at))
    return np.minimum(found, len(at))


def part_roll(docs: DataFrame, most: int, *, key: str = "mode", order: str = "seq", tokens: str = "n_tokens", together: int = TOGETHER) -> DataFrame:
    """Adds `part`: a document that doesn't fit a part that has something opens the next one.

    No task holds a key.  Running sums place the documents on an axis of tokens, on which the document
    that would open the next part after any given one is found by a search.  Tasks take stretches of some
    `together` parts each and follow those pointers for every document in which a part of the stretch could
    begin first (they lie within `most` tokens of its begin), to the first beginning in the next stretch;
    pointer doubling over these few documents, a logarithmic number of joins, says where each stretch is
    entered, and the stretches then mark their beginnings and count them.

    Documents without tokens are left out, ties in `order` are taken in one order or another, null keys are
    a key.  Returns key, order, tokens, part.
    """
    spark, width, paths = docs.sparkSession, most * together, []
    kind = dict(docs.dtypes)
    rows = written(docs.filter(F.col(tokens) > 0).select(key, order, tokens), "roll-rows", paths)
    # a document longer than a part is a part of its own, however long it is
    size = F.least(F.col(tokens).cast("long"), F.lit(most + 1))
    placed = running_sum(rows, [key], order, size, "_at").withColumn("_end", F.col("_at") + size)
    placed = written(placed.withColumn("_stretch", F.floor(F.col("_at") / width)), "roll", paths)

    def exits(part: pa.Table) -> pa.Table:
        part = part.sort_by("_at")
        at, end, own = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_at", "_end", "_own"))
        n = int(own.sum())  # those of the next stretch come last
        to = np.append(_next_starts(at, end, most), len(at))
        while (to[:n] < n).any():
            to = np.where(to < n, to[to], to)
        first = np.flatnonzero(part.column("_gap").to_numpy()[:n] <= most)
        good = first[to[first] < len(at)]
        return pa.table({"_key": part.column("_key").take(pa.array(good)), "_from": pa.array(at[good]), "_to": pa.array(at[to[good]])})

    gap = F.col("_at") - F.col("_stretch") * width
    own = placed.select(F.struct(key).alias("_key"), "_stretch", "_at", "_end", F.lit(True).alias("_own"), gap.alias("_gap"))
    ahead = own.filter((F.col("_gap") <= most) & (F.col("_stretch") > 0)).withColumns({"_stretch": F.col("_stretch") - 1, "_own": F.lit(False)})
    edges = own.unionByName(ahead).groupBy("_key", "_stretch").applyInArrow(exits, f"_key struct<{key}: {kind[key]}>, _from long, _to long")
    edges = written(edges, "roll-edges", paths)
    entered = written(placed.filter("_at = 0").select(F.struct(key).alias("_key"), F.col("_at").alias("_entry")), "roll-entries", paths)
    longest = placed.agg(F.max("_stretch").alias("n")).first().n or 0
    for _ in range(longest.bit_length()):
        reached = entered.join(edges, (entered["_key"] == edges["_key"]) & (F.col("_entry") == F.col("_from"))).select(entered["_key"], F.col("_to").alias("_entry"))
        entered = written(entered.unionByName(reached), "roll-entries", paths)
        onward = edges.select(F.col("_key").alias("_same"), F.col("_from").alias("_via"), F.col("_to").alias("_onward"))
        edges = written(edges.join(onward, (F.col("_key") == F.col("_same")) & (F.col("_to") == F.col("_via"))).select("_key", "_from", F.col("_onward").alias("_to")), "roll-edges", paths)

    def begins(part: pa.Table) -> pa.Table:
        part = part.sort_by("_at")
        at, end = part.column("_at").to_numpy(), part.column("_end").to_numpy()
        first, marks = part.column("_entry")[0].as_py(), np.zeros(len(at), np.int64)
        if first is not None:
            to, i = _next_starts(at, end, most), int(np.searchsorted(at, first))
            while i < len(at):
                marks[i] = 1
                i = int(to[i])
        return part.drop_columns(["_entry", "_key", "_stretch", "_end"]).append_column("_begins", pa.array(marks))

    keyed = placed.withColumn("_key", F.struct(key))
    entry = entered.select(F.struct("_key", F.floor(F.col("_entry") / width).alias("_stretch")).alias("_place"), "_entry")
    joined = keyed.withColumn("_place", F.struct("_key", "_stretch")).join(entry, "_place", "left").drop("_place")
    marked = written(joined.groupBy("_key", "_stretch").applyInArrow(begins, f"{key} {kind[key]}, {order} {kind[order]}, {tokens} {kind[tokens]}, _at long, _begins long"), "roll-begins")
    drop(spark, *paths)
    counted = running(marked, [key], "_at", {"part": Running(F.col("_begins"))}, inclusive=True)
    return counted.select(key, order, tokens, (F.col("part") - 1).cast("int").alias("part"))


def shuffled(windows_: DataFrame, seed: int, rank: int = 0, *, key: str, window: str = "window") -> DataFrame:
    """Adds `place`: windows in an order that the seed and the rank alone decide."""
    return hash_rank(windows_, F.md5(F.concat_ws("#", F.lit(str(seed + rank)), F.col(key).cast("string"), F.col(window).cast("string")).cast("binary")), "place")


def scan_windows(spark: SparkSession, path: str, length: int, seed: int, rank: int = 0, *, key: str = "mode", order: str = "seq", tokens: str = "tokens", with_positions: bool = True) -> DataFrame:
    """A folder of tokenised samples as fixed windows in seeded order: key, window, input_ids, place (and positions)."""
    found = shuffled(windows(spark.read.parquet(path), length, key=key, order=order, tokens=tokens), seed, rank, key=key)
    return found if with_positions else found.drop("positions")


def rank_ranges(rows: DataFrame, world: int, *, order: str) -> DataFrame:
    """Adds `rank`: equal ranges of the order; the remainder is dropped."""
    size = rows.agg(F.floor(F.count("*") / world).alias("_size"))  # one row
    numbered = row_numbers(rows, order, "_n").join(F.broadcast(size.filter("_size > 0")))
    return numbered.withColumn("rank", F.floor(F.col("_n") / F.col("_size")).cast("int")).filter(F.col("rank") < world).drop("_n", "_size")


def micro_batches(rows: DataFrame, size: int, *, keys: list[str], order: str, start: int = 0) -> DataFrame:
    """Adds `batch` within the keys, incomplete ones dropped, from batch number `start` on."""
    numbered = row_numbers(rows, order, "_n", keys=keys).withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")
    full = numbered.groupBy(*keys, "batch").count().filter(F.col("count") == size).select(*keys, "batch")
    return numbered.filter(F.col("batch") >= start).join(full, [*keys, "batch"], "left_semi")


def train_and_validation(rows: DataFrame, validation: float, *, order: str) -> DataFrame:
    """Adds `split`: the first ceil((1 - validation) * n) rows train, the rest validate."""
    most = rows.agg(F.ceil(F.lit(1 - validation) * F.count("*")).alias("_train"))  # one row
    numbered = row_numbers(rows, order, "_n").join(F.broadcast(most))
    return numbered.withColumn("split", F.when(F.col("_n") < F.col("_train"), "train").otherwise("validation")).drop("_n", "_train")
