"""Whitening of vectors by their leading principal components, without ever forming the covariance.

Entries become whole numbers, x = floor(64 c) + 1,000,000.  The components are fitted on the list of
distinct x-vectors (n of them, sums S): eigenvectors of V, the covariance with divisor n.  A block Lanczos
iteration asks only for V times a block of directions, which is one distributed pass over the list: each
task centres its rows, x - S/n taken exactly as (n x - S) / n, and adds up Xc'(Xc Q); Spark sums the
tasks' parts by row, and the driver gets d rows of as many numbers as the block has directions.
Everything else is algebra on a basis of at most d vectors:

* every new block is orthogonalised against the whole basis, twice, so no ghost copies appear;
* a direction that vanishes in that (a breakdown: the space reached so far is invariant, or V has equal
  eigenvalues) starts anew from a random vector orthogonal to the basis;
* Ritz pairs come from the basis and V times the basis, both held; they have settled when the residual
  |V u - e u| of each wanted pair is at most `tolerance` times the largest eigenvalue, or when the basis
  spans the whole space, in which case they are exact to rounding.

The trace of V is the sum of all deviations over n cubed, so the shares explained need no other eigenvalue.
Passes read one saved table; a lost executor repeats its tasks.

Vectors that are null, or hold null or non-finite entries or ones whose x would not be a whole number
below 2^53, are dropped.  The commonest length (of equally common ones the longest) is the space; vectors
of other lengths are dropped too.  Components without variance, to rounding, do not exist: a table with
one distinct vector gives no rows.  Repeated rows: a row each, and one in the list.  Ties: equal
eigenvalues share their space, with one basis for all rows.  A deviation beyond a long is null.  Null
ids: rows like others.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import arrow, saved


@dataclass(frozen=True)
class Settings:
    components: int = 16
    scale: int = 64
    shift: int = 1_000_000
    block: int = 16
    tolerance: float = 1e-14
    seed: int = 7


#: Whole numbers below this are exact as doubles; a share of the largest eigenvalue below which there is no variance.
EXACT, NOTHING = 1 << 53, 1e-13
#: Bits of an entry's lower half; halves are summed apart, so that a sum of longs is exact for any list below 2^36 rows.
HALF = 26


def whole(vector: Column, s: Settings) -> Column:
    """x of a vector; null where the vector is null or has an entry that is null, not finite or too large."""
    most = (EXACT - s.shift) / s.scale - 1
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < most))
    return F.when(good, F.transform(vector, lambda c: F.floor(c * s.scale).cast("long") + s.shift))


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass(frozen=True)
class List:
    """The fit list: its rows (column x), how many, and their sums."""

    rows: DataFrame
    n: int
    sums: np.ndarray

    @property
    def d(self) -> int:
        return len(self.sums)


def fit_list(x: DataFrame) -> List | None:
    """x: column x.  None if there is no row, or none with an entry."""
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0].d:
        return None
    d = lengths[0].d
    rows = saved(x.filter(F.size("x") == d).distinct(), "whitening-list")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for part in parts:
            if part.num_rows:
                own = _matrix(part.column(0), d)
                high, low, n = high + (own >> HALF).sum(axis=0), low + (own & ((1 << HALF) - 1)).sum(axis=0), n + len(own)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(d, dtype=np.int32)), "high": pa.array(high), "low": pa.array(low), "n": pa.array(np.full(d, n))})

    sums = arrow(rows, run, "at int, high long, low long, n long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("at").collect()
    return List(rows, sums[0].n, np.array([(r.high << HALF) + r.low for r in sums], dtype=object))


class Centre:
    """x - S / n, exactly, from whole numbers."""

    def __init__(self, n: int, sums: np.ndarray):
        # x - q is small and whole, n (x - q) - rest is n x - S
        self.n, self.quotient = n, np.array([int(s) // n for s in sums], np.int64)
        self.rest = np.array([int(s) % n for s in sums], np.int64)

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n x - S: longs, or whole numbers without a bound where longs may not do for their squares' sum."""
        small = x - self.quotient
        most = self.n * (int(np.abs(small).max(initial=0)) + 1)
        if most * most * max(x.shape[1], 1) < 1 << 63:
            return self.n * small - self.rest
        return self.n * small.astype(object) - self.rest.astype(object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        from_list = self.times_n(x)
        return [int(v) if v < 1 << 63 else None for v in (from_list * from_list).sum(axis=1)]


def product(fit: List, block: np.ndarray) -> np.ndarray:
    """V times a d x b block: one pass over the list."""
    d, centre = fit.d, Centre(fit.n, fit.sums)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(block)
        for part in parts:
            if part.num_rows:
                x = centre(_matrix(part.column(0), d))
                total += x.T @ (x @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "row"])

    sums = arrow(fit.rows, run, "at int, row array<double>").groupBy("at").agg(F.array(*(F.sum(F.get("row", F.lit(j))) for j in range(block.shape[1]))).alias("row"))
    return np.array([r.row for r in sums.orderBy("at").collect()]) / fit.n


def _orthogonal(block: np.ndarray, basis: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """The block as orthonormal directions beside the basis; what vanishes is started anew at random, as long as there is room."""
    out = basis
    room = len(basis) - basis.shape[1]
    for v in block.T[: min(block.shape[1], room)]:
        size = np.linalg.norm(v)
        for _ in range(100):
            w = v
            for _ in range(2):
                w = w - out @ (out.T @ w)
            left = np.linalg.norm(w)
            if left > 1e-10 * size and left > 0:
                w = w / left
                w = w - out @ (out.T @ w)
                out = np.column_stack([out, w / np.linalg.norm(w)])
                break
            v = r.normal(size=len(basis))  # breakdown
            size = np.linalg.norm(v)
    return out[:, basis.shape[1] :]


def lanczos(times, d: int, s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading eigenvalues (falling), their unit eigenvectors as columns, and how many passes they took.  times: a d x b block to the matrix's product with it."""
    r = np.random.default_rng([s.seed, d])
    wanted, width = min(s.components, d), min(s.block, d)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    block = _orthogonal(r.normal(size=(d, width)), basis, r)
    for passes in range(1, d + 2):
        new = times(block)
        basis, image = np.column_stack([basis, block]), np.column_stack([image, new])
        inner = basis.T @ image
        values, turned = np.linalg.eigh((inner + inner.T) / 2)
        first = np.argsort(-values)[:wanted]
        vectors, values = basis @ turned[:, first], values[first]
        residual = np.linalg.norm(image @ turned[:, first] - vectors * values, axis=0)
        if basis.shape[1] == d or (len(first) == wanted and (residual <= s.tolerance * max(values[0], 0)).all()):
            break
        block = _orthogonal(new, basis, r)
    # rounding: unit length, orthogonal, and values from the vectors themselves
    vectors = np.linalg.qr(vectors)[0]
    return values, vectors, passes


@dataclass(frozen=True)
class Whitening:
    """What the list gave: list, eigenvalues (falling, all with variance), eigenvectors as columns, the trace of V."""

    fit: List
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int

    @property
    def directions(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def learn(fit: List, s: Settings = Settings()) -> Whitening | None:
    """None if the list has no variance."""
    if fit.n < 2:
        return None
    values, vectors, passes = lanczos(lambda block: product(fit, block), fit.d, s)
    centre, d = Centre(fit.n, fit.sums), fit.d

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0  # whole numbers without a bound
        for part in parts:
            if part.num_rows:
                x = centre.times_n(_matrix(part.column(0), d))
                total += sum(map(int, (x * x).sum(axis=1)))
        yield pa.RecordBatch.from_pydict({"deviation": pa.array([float(total)])})

    deviations = arrow(fit.rows, run, "deviation double").agg(F.sum("deviation")).first()[0]
    kept = values > NOTHING * values[0]
    return Whitening(fit, values[kept], vectors[:, kept], deviations / fit.n**3, passes) if values[0] > 0 else None


def identity_error(w: Whitening) -> float:
    """The largest entry, in size, of the whitened list's covariance minus the identity: one more pass."""
    d, k, centre, directions = w.fit.d, len(w.values), Centre(w.fit.n, w.fit.sums), w.directions

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for part in parts:
            if part.num_rows:
                y = centre(_matrix(part.column(0), d)) @ directions
                total += np.column_stack([y.T @ y, y.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "row"])

    sums = arrow(w.fit.rows, run, "at int, row array<double>").groupBy("at").agg(F.array(*(F.sum(F.get("row", F.lit(j))) for j in range(k + 1))).alias("row"))
    total = np.array([r.row for r in sums.orderBy("at").collect()]) / w.fit.n
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """WHITENED: one row for each kept row and component."""
    s, spark = settings, df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("id"), whole(F.col(vector_column).cast("array<double>"), s).alias("x")).filter("x IS NOT NULL")
    fit = fit_list(rows.select("x"))
    found = learn(fit, s) if fit else None
    if not found:
        return spark.createDataFrame([], WHITENED)
    centre, d, n, k = Centre(fit.n, fit.sums), fit.d, fit.n, len(found.values)
    directions, explained, error = found.directions, found.values / found.trace, identity_error(found)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = _matrix(part.column(1), d)
            y, m = centre(x) @ directions, len(x)
            place = np.repeat(np.arange(m), k)
            deviation = pa.array(centre.deviation(x), pa.int64()).take(pa.array(place))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(place)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation, pa.array(y.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=[c.split()[0] for c in WHITENED.split(", ")],
            )

    return arrow(rows.filter(F.size("x") == d), run, WHITENED)
