"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label by a key of concatenated random hashes (signs of random
projections, most significant first) and compares every vector with the window of its neighbours whose
keys have the leading bits in common: a run of the order.  How many bits those are follows the label's
size, so that windows hold about the square root of its vectors, whatever that size is, and how many
passes there are follows the bits, so that a pair at the threshold shares a window in some pass, but for
a share of `missed` of such pairs.  A window that a dense place fills beyond `block` is compared in pairs
of blocks, so it loses nothing.

Pairs at or over the threshold, verified in double precision, are united over all passes.  A pair counts
as a link in the first pass whose window holds both, which the two vectors' own keys tell, so no pair
is ever written: a task gives a count for each vector and a spanning set of links.

Equal vectors of a label are one vertex with a weight, so copies cost nothing.  Keys are counted before
vectors move; vectors meet by window.  The work grows with the size of a label to the power 1.5 or so,
that on a dense window with its square.

Vectors that are null, empty, zero, or hold null or non-finite components, vectors without a label or
without an id: no links.  Vectors of different lengths are never compared.  Rows with equal id and
vector: each a row.  Ties have no say: a component's smallest id names it.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import arrow, free, saved
from textmill.llm.components import connected_components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    block: int = 4096
    missed: float = 1e-6
    seed: int = 13

    def bits(self, n: Column) -> Column:
        """Leading bits that windows share in a label of n vectors: windows of about the square root of n."""
        return F.ceil(F.log2(n) / 2).cast("int")

    def passes(self, bits: int) -> int:
        """A pair at the threshold agrees in a bit with the chance 1 - angle / pi."""
        same = (1 - math.acos(self.threshold) / math.pi) ** bits
        return 1 if bits == 0 else math.ceil(math.log(self.missed) / math.log(1 - same))


#: Projections of one pass; more bits than a label of 2 ** 31 windows needs.
BITS = 31


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prepare(df: DataFrame) -> DataFrame:
    """_id, _label, _vector -> id, digest (of label and vector; null for vectors that link with nothing), label, vector."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            labels, digests, vectors = part.column(1).to_pylist(), [], []
            for label, v in zip(labels, part.column(2), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if v.is_valid and not v.values.null_count else np.zeros(0)
                good = label is not None and len(x) and np.isfinite(x).all() and x.any()
                vectors.append(x if good else None)
                digests.append(hashlib.blake2b(f"{len(x)} {label}\n".encode() + x.tobytes(), digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_pydict({"id": part.column(0), "digest": pa.array(digests, pa.binary()), "label": pa.array(labels, pa.string()), "vector": pa.array(vectors, pa.list_(pa.float64()))})

    return arrow(df, run, "id long, digest binary, label string, vector array<double>")


def _stack(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1])


def _spanning(n: int, pairs: np.ndarray) -> np.ndarray:
    """Pairs (first of a part, other) that keep n places connected as the given pairs do."""
    up = np.arange(n)
    while len(pairs):  # smallest neighbours travel, and pointers are halved, until nothing changes
        a, b = up[pairs[:, 0]], up[pairs[:, 1]]
        open_ = a != b
        if not open_.any():
            break
        pairs, a, b = pairs[open_], a[open_], b[open_]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    other = np.flatnonzero(up != np.arange(n))
    return np.stack([up[other], other], axis=1)


class Keys:
    """The leading bits of vectors' keys, as integers, pass by pass."""

    def __init__(self, s: Settings):
        self.s, self.planes = s, {}

    def codes(self, x: np.ndarray, bits: int, at: int) -> np.ndarray:
        length = x.shape[1]
        if (length, at) not in self.planes:
            self.planes[length, at] = np.random.default_rng([self.s.seed, length, at]).normal(size=(length, BITS))
        return (x @ self.planes[length, at][:, :bits] > 0) @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _first_met(keys: Keys, pairs: np.ndarray, x: np.ndarray, bits: int, at: int) -> np.ndarray:
    """The pairs (rows of x) that share no window of a pass before this one."""
    if not len(pairs) or not bits:
        return pairs
    who, places = np.unique(pairs, return_inverse=True)
    places = places.reshape(pairs.shape)
    for earlier in range(at):
        codes = keys.codes(x[who], bits, earlier)
        new = codes[places[:, 0]] != codes[places[:, 1]]
        pairs, places = pairs[new], places[new]
    return pairs


def near_vectors(df: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    s = settings
    rows = df.select(F.col(id_column).cast("long").alias("_id"), F.col(label_column).cast("string").alias("_label"), F.col(vector_column).cast("array<double>").alias("_vector"))
    rows = saved(prepare(rows), "vectors")
    classes = rows.filter("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # a vertex is a class; an id with several vectors stands for each of them
    classes = saved(classes.select(F.monotonically_increasing_id().alias("vertex"), "*", F.concat_ws(" ", F.size("vector"), "label").alias("place")), "vector-classes", like=rows)
    sizes = classes.groupBy("place").count().select("place", s.bits(F.col("count")).alias("bits"))

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(s)
        for part in parts:
            vectors, bits, places = _stack(part.column(3)), part.column(2).to_numpy(), part.column(1)
            lengths = np.array([len(v) for v in vectors])
            for length, b in sorted(set(zip(lengths.tolist(), bits.tolist(), strict=True))):
                mine = np.flatnonzero((lengths == length) & (bits == b))
                x, own, of = _unit(np.stack([vectors[i] for i in mine])), part.column(0).take(pa.array(mine)), places.take(pa.array(mine))
                for at in range(s.passes(b)):
                    code = keys.codes(x, b, at) if b else np.zeros(len(mine), np.int64)
                    yield pa.RecordBatch.from_pydict({"place": of, "pass": pa.array(np.full(len(mine), at, np.int32)), "code": pa.array(code), "vertex": own})

    ordered = saved(arrow(classes.join(sizes, "place").select("vertex", "place", "bits", "vector"), windows, "place string, pass int, code long, vertex long").select(F.xxhash64("place", "pass", "code").alias("h"), "pass", "vertex"), "vector-keys")
    full = ordered.groupBy("h").count().filter("count > 1").select("h", F.ceil(F.col("count") / s.block).cast("int").alias("blocks"))
    member = ordered.join(full, "h").withColumn("own", F.pmod(F.xxhash64("vertex", F.lit(5)), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("unit")
    member = member.select(unit, "pass", (F.col("own") <= F.col("other")).alias("left"), (F.col("own") == F.col("other")).alias("same"), "vertex")
    member = member.join(classes.join(sizes, "place").select("vertex", "weight", "bits", "vector"), "vertex").select("unit", "pass", "left", "same", "bits", "vertex", "weight", "vector")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(s)

        def done(group: list) -> Iterator[pa.RecordBatch]:
            at, _, same, bits = group[0][:4]
            ids, weight = np.array([g[4] for g in group], np.int64), np.array([g[5] for g in group], np.int64)
            x, left = _unit(np.stack([g[6] for g in group])), np.array([g[1] for g in group])
            one = np.arange(len(group)) if same else np.flatnonzero(left)
            two = one if same else np.flatnonzero(~left)
            count, linked = np.zeros(len(group), np.int64), []
            for begin in range(0, len(one), 512):
                i, j = np.nonzero(x[one[begin : begin + 512]] @ x[two].T >= s.threshold)
                pairs = np.stack([one[begin + i], two[j]], axis=1)
                if same:
                    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
                pairs = _first_met(keys, pairs, x, bits, at)
                np.add.at(count, pairs[:, 0], weight[pairs[:, 1]])
                np.add.at(count, pairs[:, 1], weight[pairs[:, 0]])
                linked.append(_spanning(len(group), pairs))
            links = _spanning(len(group), np.concatenate(linked)) if linked else np.zeros((0, 2), np.int64)
            some = np.flatnonzero(count)
            if len(some):
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[some]), "n": pa.array(count[some]), "other": pa.nulls(len(some), pa.int64())})
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[links[:, 0]]), "n": pa.array(np.zeros(len(links), np.int64)), "other": pa.array(ids[links[:, 1]])})

        unit, group = None, []
        for part in parts:
            columns = [part.column(k).to_pylist() for k in range(7)] + [_stack(part.column(7))]
            for u, *rest in zip(*columns, strict=True):
                if u != unit:
                    if group:
                        yield from done(group)
                    unit, group = u, []
                group.append(rest)
        if group:
            yield from done(group)

    counted = saved(arrow(member.repartition("unit").sortWithinPartitions("unit", "vertex"), compare, "id long, n long, other long"), "vector-links")
    free(ordered)
    links = counted.filter("other IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(counted.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of_part = classes.select(F.col("vertex").alias("id"), F.col("id").alias("least")).join(parts, "id")
    least = of_part.groupBy("component").agg(F.min("least").alias("least"))
    placed = classes.select(F.col("vertex").alias("id"), "digest", "weight", F.col("id").alias("own"))
    placed = placed.join(links, "id", "left").join(of_part.select("id", "component"), "id", "left").join(least, "component", "left")
    placed = placed.select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "own").alias("component_id"))
    # without an id a vector is no vertex, even if others with its label equal it
    good = F.when(F.col("id").isNotNull(), F.col("digest"))
    out = rows.select("id", good.alias("digest")).join(placed, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component.isNull() | (component == F.col("id"))).alias("kept"))
