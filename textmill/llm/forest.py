"""Near-duplicate texts by an LSH forest of MinHash signatures.

A text is the set of hashes of its word shingles.  Texts with equal sets are one class at once; the
forest is built over classes.

* Each of `trees` orders reads the signature from another place.  Texts that share a tree's first
  values are a region of that order, neighbours with a common prefix.
* Texts in a region of more than `region` members go through a second forest of `fine_trees` orders.
  There each region goes deeper, prefix by prefix, while it is too large, down to the depth at which a
  pair at the threshold still meets in some order (all but `missed` of such pairs).  What is too large
  even there is compared in pairs of blocks.  Texts with equal signatures enter it as one.
* Within a region the whole signatures are compared, and those that agree in enough places are joined.
  What is joined over all trees is a candidate component; texts outside share none.
* A component's full sets are brought together once.  From a text outward, those that are not yet
  reached and whose signatures agree enough are compared on full sets; what passes is reached.  So
  every possible link of a component that could join two of its parts has been compared in full.
  A component too large for one task (`together` texts or `shingles` in their sets) is cut into blocks,
  and every pair of blocks is compared by one task.  Beyond `most_blocks` blocks, blocks are of texts
  of like size, and pairs whose sizes are too far apart for any link are left out; no link is.

Signatures, regions and components move, texts once, sets once for candidates; links are a spanning
star for each task, never all pairs of a group.

Very long texts are hashed in parts; ties have no say, as a component's smallest id names it.
Null texts or texts without words: n_shingles 0, linked with nothing.  Rows with a null id: linked
with nothing, component null, kept.  Rows with the same id are one document.  Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import arrow, claim, free, saved, text_of
from textmill.llm.components import connected_components


@dataclass(frozen=True)
class Settings:
    words: int = 3
    percent: int = 85
    values: int = 96
    trees: int = 16
    first_depth: int = 2
    fine_trees: int = 64
    region: int = 2048
    together: int = 4096
    shingles: int = 2_000_000
    most_blocks: int = 64
    missed: float = 1e-6
    seed: int = 11

    def agreeing(self) -> list[float]:
        """Chances that a pair at the threshold agrees in 0, 1, ... values of its signatures."""
        p, n = self.percent / 100, self.values
        return [math.comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(n + 1)]

    def least(self) -> int:
        """Values that a pair at the threshold agrees in, but for a share of `missed`."""
        total = 0.0
        for m, chance in enumerate(self.agreeing()):
            total += chance
            if total > self.missed:
                return m
        return self.values

    def deepest(self) -> int:
        """The greatest depth at which a pair at the threshold shares a region of the second forest, but for a share of `missed`."""
        for depth in range(self.first_depth, self.values):
            lost = sum(chance * (1 - math.comb(m, depth) / math.comb(self.values, depth)) ** self.fine_trees for m, chance in enumerate(self.agreeing()))
            if lost > self.missed:
                return max(self.first_depth, depth - 1)
        return self.values


#: Bytes of a text hashed at once.
PART = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(3).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.full(max(n, 1 << 16), base, np.uint64)
            known[0] = 1
            known = np.cumprod(known, dtype=np.uint64)
        if n <= 1 << 21:
            _powers[str(base)] = known
    return known


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes, A-Z lower-cased."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[_LOWER[data]] * _power(_BASE, len(data))[: len(data)], dtype=np.uint64)])
        return _mixed((sums[end] - sums[begin]) * _power(_INVERSE, len(data) + 1)[begin] + (end - begin).astype(np.uint64))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; with fewer words than a shingle has, one of them all."""
    raw = text.encode("utf-8", "replace")
    hashes, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > PART:
            stop = re.compile(rb"[\x20\x09-\x0d]").search(raw, at + PART)
            end = stop.end() if stop else end
        hashes.append(word_hashes(np.frombuffer(raw, np.uint8, end - at, at)))
        at = end
    w = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = min(words, len(w))
    out = np.zeros(len(w) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = _mixed(out * np.uint64(0x100000001B3) + w[k : len(w) - n + 1 + k])
        return np.unique(out + np.uint64(n))


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    out = np.empty(len(multipliers), np.uint32)
    with np.errstate(over="ignore"):
        for k, m in enumerate(multipliers):
            out[k] = ((hashes * m) >> np.uint64(32)).min()
    return out


def _multipliers(s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).integers(0, 2**63, s.values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(df: DataFrame, s: Settings) -> DataFrame:
    """_key, _id, _text -> key, id, n, digest, signature (null for texts without words), low: the last byte of each of its values."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        claim("forest", _powers.clear)
        multipliers = _multipliers(s)
        for part in parts:
            n, digests, signs, low = [], [], [], []
            for text in part.column(2):
                h = shingles(text.as_py(), s.words)
                n.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                own = signature(h, multipliers) if len(h) else None
                signs.append(None if own is None else own.view(np.int32))
                low.append(None if own is None else own.astype(np.uint8).tobytes())
            columns = {"n": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()), "signature": pa.array(signs, pa.list_(pa.int32())), "low": pa.array(low, pa.binary())}
            yield pa.RecordBatch.from_pydict({"key": part.column(0), "id": part.column(1)} | columns)

    return arrow(df, run, f"key {df.schema['_key'].dataType.simpleString()}, id long, n long, digest binary, signature array<int>, low binary")


def _grouped(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list]]:
    """Runs of rows with equal first column, as lists of tuples of the rest."""
    key, rows = None, []
    for part in parts:
        columns = [c.to_pylist() if not pa.types.is_list(c.type) else c for c in part.columns]
        arrays = [None if not isinstance(c, pa.Array) else (c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))])) for c in columns]
        for i, k in enumerate(columns[0]):
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(tuple(c[i] if a is None else a[0][a[1][i] : a[1][i + 1]] for c, a in zip(columns[1:], arrays[1:], strict=True)))
    if rows:
        yield key, rows


def _agree(one: np.ndarray, others: np.ndarray, least: int) -> np.ndarray:
    return (others == one).sum(axis=1) >= least


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _spread(ids: list[int], signs: np.ndarray, least: int, check=None) -> tuple[list[int], list[int]]:
    """Breadth first over texts whose signatures agree (and that pass check): links from the first of each part to the others."""
    rest, a, b = np.arange(len(ids)), [], []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        root = ids[queue[0]]
        while queue and len(rest):
            i = queue.pop()
            hit = _agree(signs[i], signs[rest], least)
            if check is not None and hit.any():
                hit[hit] = check(i, rest[hit])
            found = rest[hit]
            if len(found):
                rest = rest[~hit]
                queue.extend(found.tolist())
                a.extend([root] * len(found))
                b.extend(ids[j] for j in found)
    return a, b


def _several(now: DataFrame) -> DataFrame:
    """h, count of the regions with two members or more."""
    return now.groupBy("h").count().filter("count > 1")


def _paired(now: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """h, id: each pair of blocks of the regions as a region."""
    counts = sizes.select("h", F.ceil(F.col("count") / s.region).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    paired = now.join(counts, "h").select("h", "id", "blocks", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    # a block meets itself in its pairs with others
    return paired.filter("i <> j").select(F.xxhash64("h", F.least("i", "j"), F.greatest("i", "j")).alias("h"), "id")


def regions(signs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """h, id: regions of both forests, to be compared whole; a, b: links of texts with equal signatures.  signs: id, signature."""
    stride = max(1, s.values // s.trees)
    doubled = signs.select("id", F.concat("signature", "signature").alias("sig"))
    all_trees = doubled.select("id", F.explode(F.sequence(F.lit(0), F.lit(s.trees - 1))).alias("t"), "sig")
    now = saved(all_trees.select("id", F.xxhash64("t", F.slice("sig", F.col("t") * stride + 1, s.first_depth)).alias("h")), "forest")
    member = saved(now.join(_several(now), "h").select("h", "id", (F.col("count") > s.region).alias("large")), "regions", like=now)
    free(now)
    out = member.filter("NOT large").select("h", "id")
    if not member.filter("large").limit(1).count():
        return out, signs.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    crowded = saved(signs.join(member.filter("large").select("id").distinct(), "id", "left_semi"), "crowded")
    alike = saved(crowded.groupBy("signature").agg(F.min("id").alias("id")), "equal-signatures", like=crowded)
    twins = crowded.withColumnRenamed("id", "b").join(alike.withColumnRenamed("id", "a"), "signature").filter("a <> b").select("a", "b")
    rng = np.random.default_rng([s.seed, 2])
    deepest = s.deepest()
    orders = F.array(*(F.array(*(F.lit(int(i)) for i in rng.permutation(s.values)[:deepest])) for _ in range(s.fine_trees)))
    left = alike.select("id", "signature", F.explode(F.sequence(F.lit(0), F.lit(s.fine_trees - 1))).alias("t"))
    for depth in sorted({min(s.first_depth + 1, deepest), *range(s.first_depth + 2, deepest, 2), deepest}):
        prefix = F.transform(F.slice(F.get(orders, F.col("t")), 1, depth), lambda i: F.get("signature", i))
        now = saved(left.select("id", "t", F.xxhash64(F.lit(-depth), "t", prefix).alias("h")), "fine-forest")
        sizes = saved(_several(now), "regions", like=now)
        out = out.unionByName(now.join(sizes.filter(F.col("count") <= s.region), "h", "left_semi").select("h", "id"))
        large = sizes.filter(F.col("count") > s.region)
        if not large.limit(1).count():
            return out, twins
        left = alike.select("id", "signature").join(now.join(large, "h", "left_semi").select("id", "t"), "id")
    return out.unionByName(_paired(now.select("h", "id"), large, s)), twins


def _units(member: DataFrame, s: Settings, like: DataFrame | None = None) -> DataFrame:
    """unit, id: what one task compares, so that any two texts of a component that may be linked share a unit.  member: component, id, n (several rows for an id with several sets)."""
    blocks = F.greatest(F.ceil(F.count("*") / s.together), F.ceil(F.sum("n") / s.shingles)).cast("int")
    sizes = member.groupBy("component").agg((blocks > s.most_blocks).alias("banded"))
    # sizes of linked texts differ by a factor of 100 / percent at most, so by one band at most
    width = max(math.log(100 / s.percent), 0.01) * 1.001
    band = F.when(F.col("banded"), F.floor(F.log("n") / width)).otherwise(0).cast("int")
    member = saved(member.join(sizes, "component").select("component", "id", "n", "banded", band.alias("band")), "members", like=like)
    bands = member.groupBy("component", "band").agg(blocks.alias("blocks"))
    own = member.join(bands, ["component", "band"]).select("component", "id", "band", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int").alias("i"), F.explode(F.when(F.col("banded"), F.sequence(F.col("band") - 1, F.col("band") + 1)).otherwise(F.array("band"))).alias("near"))
    paired = own.join(bands.withColumnRenamed("band", "near"), ["component", "near"]).select("component", "id", "band", "i", "near", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    # with several blocks, a block meets itself in its pairs with others
    paired = paired.filter((F.col("band") != F.col("near")) | (F.col("i") != F.col("j")) | (F.col("blocks") == 1))
    block = lambda b, i: F.col(b).cast("long") * (1 << 32) + F.col(i)
    one, other = block("band", "i"), block("near", "j")
    return paired.select(F.xxhash64("component", F.least(one, other), F.greatest(one, other)).alias("unit"), "id").distinct()


def _components(docs: DataFrame, rows: DataFrame, s: Settings, by_id: bool = False) -> DataFrame:
    """digest, component of the texts with words.  docs: _key, _text; rows: what `sketches` gives of them, saved.  by_id: keys are ids."""
    known = rows.filter("n > 0 AND id IS NOT NULL")
    classes = saved(known.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("low").alias("low")), "classes", like=rows)
    # where a document has several sets, they are one vertex; each set's signature counts
    signs = classes.select("id", "n", "signature")
    least, multipliers = s.least(), _multipliers(s)
    found, twins = regions(signs.select("id", "signature"), s)

    def guess(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(parts):
            # values agree where their last bytes do, and elsewhere once in 256 times: no pair is lost, hardly any is added
            low = np.frombuffer(b"".join(g[1] for g in group), np.uint8).reshape(len(group), -1)
            a, b = _spread([g[0] for g in group], low, least)
            if a:
                yield _edges(a, b)

    by_region = found.join(classes.select("id", "low"), "id").select("h", "id", "low").repartition("h").sortWithinPartitions("h", "id")
    rough = connected_components(arrow(by_region, guess, "a long, b long").unionByName(twins))
    units = _units(rough.join(signs.select("id", "n"), "id"), s, like=rough)
    if by_id:
        texts = docs.join(rough.select(F.col("id").alias("_key")), "_key", "left_semi").select(F.col("_key").alias("id"), "_text")
    else:
        wanted = known.join(rough, "id", "left_semi").select(F.col("key").alias("_key"), "id").distinct()
        texts = docs.join(wanted, "_key").select("id", "_text")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("forest", _powers.clear)
        for part in parts:
            for at in range(0, part.num_rows, 200):
                own = [shingles(x.as_py(), s.words) for x in part.column(1).slice(at, 200)]
                yield pa.RecordBatch.from_pydict({"id": part.column(0).slice(at, 200), "hashes": pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))})

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(parts):
            ids = [g[0] for g in group]
            own = [g[1].view(np.uint64) for g in group]
            kept = [i for i, x in enumerate(own) if len(x)]
            ids, own = [ids[i] for i in kept], [own[i] for i in kept]
            if len(ids) < 2:
                continue

            def linked(i: int, others: np.ndarray, own=own) -> np.ndarray:
                out = np.zeros(len(others), bool)
                for begin in range(0, len(others), 256):
                    some = others[begin : begin + 256]
                    lengths = np.array([len(own[j]) for j in some])
                    every = np.concatenate([own[j] for j in some])
                    at = np.minimum(np.searchsorted(own[i], every), len(own[i]) - 1)
                    common = np.add.reduceat((own[i][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
                    out[begin : begin + 256] = 100 * common >= s.percent * (len(own[i]) + lengths - common)
                return out

            a, b = _spread(ids, np.stack([signature(x, multipliers) for x in own]), least, linked)
            if a:
                yield _edges(a, b)

    together = units.join(arrow(texts, sets, "id long, hashes array<bigint>"), "id").select("unit", "id", "hashes").repartition("unit").sortWithinPartitions("unit", "id")
    final = connected_components(arrow(together, verify, "a long, b long"))
    return classes.select("digest", "id").join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))


def near_components(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    own = F.col(id_column).cast("long")
    docs = df.select(own.alias("_key"), own.alias("_id"), text_of(text_column).alias("_text"))
    rows = saved(sketches(docs, settings), "sketches")
    placed = _components(docs.select("_key", "_text"), rows, settings, by_id=True)
    out = rows.select("id", "n", "digest").join(placed, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (component.isNull() | (component == F.col("id"))).alias("kept"))


def without_near_duplicates(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """df with one row of each group: the one with the smallest id (null last), among equal ids the one with the smallest digest.

    Every row is a text of its own here, whatever its id is, so rows with a null id and different
    texts with one id are compared too.  Rows without words are in no group and stay.
    """
    id_, text = F.col(id_column).cast("string"), text_of(text_column)
    key = F.md5(F.concat(F.coalesce(F.concat(id_, F.lit("+")), F.lit("-")), text).cast("binary"))
    docs = df.select(key.alias("_key"), F.col(id_column).cast("long").alias("_id"), text.alias("_text"))
    own = saved(sketches(docs, settings).withColumnRenamed("id", "own").withColumn("id", F.monotonically_increasing_id()), "sketches")
    placed = _components(docs.select("_key", "_text"), own, settings)
    first = own.filter("n > 0").join(placed, "digest").groupBy("component").agg(F.min(F.struct(F.col("own").isNull(), "own", "key")).alias("x")).select(F.col("x.key").alias("_near_key"))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")  # whatever columns are called, none is lost
    word = text.rlike(r"[^\x20\x09-\x0D]")
    keyed = df.filter(word).select(key.alias("_near_key"), row)
    return keyed.join(first, "_near_key", "left_semi").dropDuplicates(["_near_key"]).select("_row").unionByName(df.filter(~word).select(row)).select("_row.*")
