"""Exact removal of repeated passages, by column-wise construction of a Burrows-Wheeler transform.

Every byte that lies in a string of `length` bytes which also starts earlier goes.  The work:

1. Anchors.  In each window of `length` bytes the `gram`-byte string with the smallest hash is an
   anchor.  Two equal windows have the same anchor at the same place, so only texts around anchors
   that occur twice can repeat.  One text byte in some 35 is an anchor.
2. Contexts.  An anchor's context is all bytes of the windows that hold it, the anchor at a fixed
   column.  Equal contexts are one class, known by a hash; all but its first occurrence repeat whole.
3. Transform.  The different contexts of one anchor are documents of equal length, aligned by column.
   Their collection transform is built a column at a time from the last to the first: each round
   inserts one symbol of every document before its suffix, which moves the documents into their next
   order by one stable sort of the symbols, and updates the common prefix lengths of neighbours from
   those of the round before.  A round reads what the round before wrote, front to back, and nothing
   else.  (Documents are aligned, so suffixes of different columns needn't be interleaved.)  Where
   neighbours have `length` symbols in common they hold the same string; all but the first repeat.
4. Removal.  Each text's repeated stretches are united and cut.

Anchors are found once and saved; their hashes are counted before anything else moves; only repeated
anchors' places go back to their texts, and a filter of fixed size keeps most others from being sent.  Texts are shuffled once, into a bucketed table of those that have repeated anchors.  Contexts
meet by anchor in blocks; an anchor with more than `most_contexts` different contexts is split, and
what is first in its split is compared over all splits by the digest of the string.

Texts are UTF-8 bytes; null is empty.  Order: doc_id, null last, then the MD5 digest of the text, then
place.  Rows with equal id and text are one document and have one result; different texts under one
id (or none) are told apart by a number in the order of their digests.  A long text of one repeated
character has an anchor at each place, so its list of places is as long as it is.  Texts shorter than
`length` lose nothing.  Empty table: no rows.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import arrow, bytes_of, claim, free, open_fs, saved, scratch, text_of


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 32
    block: int = 8192
    most_contexts: int = 100_000


#: Bytes of a text hashed at once; parts overlap by a context.
PART = 1 << 20
_CODES = np.random.default_rng(23).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LAST = (1 << 63) - 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, PART + 4096), _powers(_INVERSE, PART + 4096)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _sums(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * _UP[: len(data)], dtype=np.uint64, out=out[1:])
        return out


def _slide(x: np.ndarray, w: int, f: np.ufunc, filler: np.uint64) -> np.ndarray:
    """f over each w consecutive values, from running values within blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, filler, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors."""
    places, hashes, w = [], [], s.length - s.gram + 1
    begin = 0
    while begin + s.length <= len(data):
        part = data[begin : begin + PART + s.length - 1]  # windows that start in this part
        sums = _sums(part)
        n = len(part) - s.gram + 1
        with np.errstate(over="ignore"):
            h = _mixed((sums[s.gram :] - sums[:n]) * _DOWN[:n])
        least = _slide(h, w, np.minimum, np.uint64(2**64 - 1))
        # a place is an anchor if it is the least of some window: if the greatest of its windows' least values is its own
        around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        found = np.flatnonzero(_slide(around, w, np.maximum, np.uint64(0)) == h)
        places.append(found + begin)
        hashes.append(h[found])
        begin += PART
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _bounds(at: np.ndarray, n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor's context, cut to the text."""
    return np.maximum(at - (s.length - s.gram), 0), np.minimum(at + s.length, n)


def context_hashes(data: np.ndarray, at: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each anchor and of its context (what is cut off at the text's ends is part of it)."""
    anchor, context = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    begin = 0
    low, high = _bounds(at, len(data), s)
    while begin < len(data):
        own = (at >= begin) & (at < begin + PART)
        if own.any():
            start = max(0, begin - s.length)
            sums = _sums(data[start : begin + PART + s.length])
            with np.errstate(over="ignore"):
                a, x, y = at[own] - start, low[own] - start, high[own] - start
                anchor[own] = _mixed((sums[a + s.gram] - sums[a]) * _DOWN[a])
                context[own] = _mixed((sums[y] - sums[x]) * _DOWN[x] + np.uint64(1009) * (a - x).astype(np.uint64) + (y - a).astype(np.uint64))
        begin += PART
    return anchor, context


class Columns:
    """Arrays of one length in a sequential file of the shared folder: written front to back, then read front to back."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.path)

    def append(self, *arrays: np.ndarray) -> None:
        for x in arrays:
            self.file.write(np.ascontiguousarray(x))

    def rewind(self) -> None:
        self.file.close()
        self.file = self.fs.open_input_stream(self.path)

    def next(self, n: int, kind: type) -> np.ndarray:
        return np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind)

    def drop(self) -> None:
        self.file.close()
        self.fs.delete_file(self.path)


def construct(texts: Columns, transform: Columns, m: int, n: int) -> None:
    """The collection transform of n documents of m columns, from the last column to the first.

    texts: each column's symbols, last column first.  Each round appends its order of the documents
    and how many symbols neighbours share from its column on.
    """
    order, common = np.arange(n, dtype=np.int32), np.zeros(n, np.int16)  # common[i]: symbols that order[i - 1] and order[i] share from here on
    for _ in range(m):
        symbols = texts.next(n, np.uint16)[order]  # the transform's column: what stands before each suffix, in suffix order
        move = np.argsort(symbols, kind="stable")
        sorted_ = symbols[move]
        same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
        after = np.zeros(n, np.int16)
        if len(same):
            pairs = np.empty(2 * len(same), np.int64)
            pairs[::2], pairs[1::2] = move[same] + 1, move[same + 1] + 1
            after[same + 1] = np.minimum.reduceat(np.append(common, np.int16(0)), pairs)[::2] + 1
        order, common = order[move], after
        transform.append(order, common)


def columns(texts: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, at: str) -> np.ndarray:
    """Which strings of `length` columns also stand in a document of smaller rank, at the same column.

    texts: columns x documents, symbols; document i has columns [low[i], high[i]).  at: where the two
    files are while they are needed.  Returns first columns x documents.
    """
    m, n = texts.shape
    symbols, transform = Columns(f"{at}.symbols"), Columns(f"{at}.transform")
    try:
        for j in range(m - 1, -1, -1):
            symbols.append(texts[j])
        symbols.rewind()
        construct(symbols, transform, m, n)
        transform.rewind()
        out = np.zeros((m - length + 1, n), bool)
        for j in range(m - 1, -1, -1):
            order, common = transform.next(n, np.int32), transform.next(n, np.int16)
            if j <= m - length:
                starts = np.flatnonzero(common < length)
                ranks = rank[order]
                first = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, n)))
                fits = (low[order] <= j) & (j + length <= high[order])
                out[j, order] = (ranks > first) & fits
        return out
    finally:
        symbols.drop()
        transform.drop()


def _versions(df: DataFrame, id_column: str, text_column: str) -> DataFrame | None:
    """doc, digest, v (1 and more) of the texts whose id, or lack of one, has several; None without any."""
    own = df.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("doc"), F.md5(text_of(text_column).cast("binary")).alias("digest"))
    # ids with several rows first: their texts alone need digests
    several = saved(own.groupBy("doc").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).filter("one <> other").select("doc"), "repeated-ids")
    if not several.limit(1).count():
        return None
    texts = own.join(several, "doc", "left_semi").distinct().repartitionByRange("doc", "digest").sortWithinPartitions("doc", "digest")
    return saved(texts.withColumn("v", F.monotonically_increasing_id() + 1), "versions")


def _keyed(df: DataFrame, id_column: str, text_column: str, versions: DataFrame | None) -> DataFrame:
    """df with _doc and _v, which name a document; _v is 0 for the only text of an id."""
    df = df.withColumn("_doc", F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)))
    if versions is None:
        return df.withColumn("_v", F.lit(0).cast("long"))
    own = versions.select(F.col("doc").alias("_of"), F.col("digest").alias("_digest"), F.col("v").alias("_v"))
    here = (F.col("_doc") == F.col("_of")) & (F.md5(text_of(text_column).cast("binary")) == F.col("_digest"))
    return df.join(own, here, "left").withColumn("_v", F.coalesce("_v", F.lit(0).cast("long"))).drop("_of", "_digest")


def _bytes(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer() if x.is_valid else b"", np.uint8)


def _bucketed(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cuts lineage as `saved` does; tables of equal buckets of (doc, v) are joined without a shuffle."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = "textmill_" + path.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, "doc", "v").options(path=path, **options).saveAsTable(table)
    atexit.register(_forget, spark, table)
    return spark.table(table)


def _forget(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # noqa: BLE001  the session has ended, and its catalog with it unless that is kept elsewhere
        pass


#: Words of 64 bits of the filter that keeps most single anchors from moving: 16 MB, whatever the input is.
FILTER_WORDS = 1 << 21


def _filter(repeated: DataFrame) -> np.ndarray:
    """A bit for each hash; hashes that share a bit only let a few more anchors through."""
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int")
    bits = repeated.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    rows = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


#: Anchors in one row at most.
ROW_ANCHORS = 50_000


def _anchor_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """doc, v, pos, h: places and hashes of the texts' anchors, as arrays; a text with many has several rows."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("passages")
        for part in parts:
            doc, v = (part.column(k).to_numpy() for k in range(2))
            rows, held, count = [], [], 0
            for i, text in enumerate(part.column(2)):
                at, h = anchors(_bytes(text), s)
                for k in range(0, len(at), ROW_ANCHORS):
                    rows.append(i)
                    held.append((at[k : k + ROW_ANCHORS].astype(np.int32), h[k : k + ROW_ANCHORS].view(np.int64)))
                    count += len(held[-1][0])
                    if count >= ROW_ANCHORS:
                        yield _arrays(doc[rows], v[rows], held)
                        rows, held, count = [], [], 0
            if rows:
                yield _arrays(doc[rows], v[rows], held)

    return arrow(docs, run, "doc long, v long, pos array<int>, h array<bigint>")


def _arrays(doc: np.ndarray, v: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(at) for at, _ in held)]).astype(np.int32)
    pos, h = (pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[k] for x in held]))) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(v), pos, h], names=["doc", "v", "pos", "h"])


def _let_through(rows: DataFrame, wanted: Broadcast) -> DataFrame:
    """h, doc, v, pos of the anchors that the filter lets through."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("passages", lambda: vars(wanted).pop("_value", None))
        for part in parts:
            doc, v, pos, h = part.columns
            times, every = h.value_lengths().to_numpy(), h.flatten().to_numpy().view(np.uint64)
            word = wanted.value[(every >> np.uint64(6)) & np.uint64(FILTER_WORDS - 1)]
            known = (word >> (every & np.uint64(63))) & np.uint64(1) > 0
            who = np.repeat(np.arange(len(times)), times)[known]
            yield pa.RecordBatch.from_pydict({"h": every[known].view(np.int64), "doc": doc.to_numpy()[who], "v": v.to_numpy()[who], "pos": pos.flatten().to_numpy()[known]})

    return arrow(rows, run, "h long, doc long, v long, pos int")


def repeated_stretches(docs: DataFrame, s: Settings, with_kept: bool = False) -> DataFrame:
    """doc, v, n_removed, n_spans, kept_sha256 (and the kept text) of the documents that lose bytes.  docs: doc, v, text."""
    back = s.length - s.gram
    files = scratch(docs.sparkSession, "columns")
    long_ = docs.filter(F.octet_length("text") >= s.length)
    found = saved(_anchor_rows(long_, s), "anchors")
    repeated = saved(found.select(F.explode("h").alias("h")).groupBy("h").count().filter("count > 1").select("h"), "repeated-anchors", like=found)
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(repeated))
    places = _let_through(found, wanted).join(repeated, "h").groupBy("doc", "v").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    places, size = saved(places, "places", like=found), bytes_of(found)
    free(found, repeated)
    texts = _bucketed(long_.join(places, ["doc", "v"]).dropDuplicates(["doc", "v"]), "repeating-texts", compression="zstd")

    def contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            doc, v = (part.column(k).to_numpy() for k in range(2))
            for i, (text, places) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                at = places.values.to_numpy().astype(np.int64)
                h, x = context_hashes(_bytes(text), at, s)
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "x": x.view(np.int64), "doc": np.repeat(doc[i], len(at)), "v": np.repeat(v[i], len(at)), "pos": at.astype(np.int32)})

    classes = arrow(texts.select("doc", "v", "text", "places"), contexts, "h long, x long, doc long, v long, pos int")
    classes = saved(classes.groupBy("h", "x").agg(F.min(F.struct("doc", "v", "pos")).alias("first")).select("h", "x", "first.*"), "contexts", like=size)
    free(places)
    several = classes.groupBy("h").count().filter("count > 1")
    firsts = classes.join(several, "h", "left").select("doc", "v", F.struct("pos", "h", F.coalesce("count", F.lit(1)).alias("n")).alias("f"))
    firsts = _bucketed(firsts.groupBy("doc", "v").agg(F.collect_list("f").alias("firsts")), "first-contexts")
    free(classes)
    width = back + s.length

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc, v, text, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                data, rows = _bytes(text), [f for f in own.as_py() if f["n"] > 1]
                if not rows:
                    continue
                raw = data.tobytes()
                low, high = _bounds(np.array([f["pos"] for f in rows]), len(data), s)
                hot = [hash((doc, v, f["pos"])) % -(-f["n"] // s.most_contexts) for f in rows]
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": pa.array([f["h"] for f in rows], pa.int64()),
                        "salt": pa.array(hot, pa.int32()),
                        "split": pa.array([f["n"] > s.most_contexts for f in rows]),
                        "doc": pa.array([doc] * len(rows), pa.int64()),
                        "v": pa.array([v] * len(rows), pa.int64()),
                        "pos": pa.array([f["pos"] for f in rows], pa.int32()),
                        "text": pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary()),
                    }
                )

    def transform(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(block).combine_chunks()
            split, doc, v, pos = (table.column(k).to_numpy() for k in ("split", "doc", "v", "pos"))
            text = table.column("text").chunk(0)
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2], np.uint8)
            n = len(doc)
            low = back - np.minimum(back, pos.astype(np.int64))
            high = low + np.diff(ends)
            x = np.full((width, n), 256, np.uint16)
            for i in range(n):
                x[low[i] : high[i], i] = raw[ends[i] : ends[i + 1]]
            rank = np.empty(n, np.int32)
            rank[np.lexsort((pos, v, doc))] = np.arange(n, dtype=np.int32)
            found = columns(x, rank, low, high, s.length, f"{files}/{uuid.uuid4().hex}")
            # runs of repeated strings of a document become one stretch
            edge = np.zeros((1, n), bool)
            begins, stops = np.argwhere(found & ~np.concatenate([edge, found[:-1]])), np.argwhere(found & ~np.concatenate([found[1:], edge]))
            begins, stops = begins[np.lexsort((begins[:, 0], begins[:, 1]))], stops[np.lexsort((stops[:, 0], stops[:, 1]))]
            who, first, last = begins[:, 1], begins[:, 0], stops[:, 0]
            digests: list[bytes | None] = [None] * len(who)
            if split.any():  # first in its split: the other splits may hold the string too
                at = np.arange(len(found))[:, None]
                open_ = np.argwhere(~found & split & (low <= at) & (at + s.length <= high))
                who, first, last = (np.concatenate([a, b]) for a, b in ((who, open_[:, 1]), (first, open_[:, 0]), (last, open_[:, 0])))
                digests += [hashlib.blake2b(x[j : j + s.length, i].astype(np.uint8).tobytes(), digest_size=16).digest() for j, i in open_.tolist()]
            start = pos[who].astype(np.int64) - back
            return pa.RecordBatch.from_pydict({"doc": doc[who], "v": v[who], "begin": start + first, "end": start + last + s.length, "digest": pa.array(digests, pa.binary())})

        claim("passages")
        last, block, held = None, [], 0
        for part in parts:
            keys = np.stack([part.column("h").to_numpy(), part.column("salt").to_numpy().astype(np.int64)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            begin = 0
            for cut in cuts[:-1]:  # units begin here
                if held + cut - begin >= s.block and tuple(keys[cut]) != last:
                    if cut > begin:
                        block.append(part.slice(begin, cut - begin))
                    if block:
                        yield done(block)
                    block, held, begin = [], 0, cut
                last = tuple(keys[cut])
            if len(keys) > begin:
                block.append(part.slice(begin))
                held += len(keys) - begin
        if block:
            yield done(block)

    schema = "h long, salt int, split boolean, doc long, v long, pos int, text binary"
    cut_ = arrow(texts.select("doc", "v", "text").join(firsts, ["doc", "v"]).select("doc", "v", "text", "firsts"), cut, schema)
    found = arrow(cut_.repartition("h", "salt").sortWithinPartitions("h", "salt"), transform, "doc long, v long, begin long, end long, digest binary")
    found = saved(found, "repeats")
    split = found.filter("digest IS NOT NULL")
    least = split.groupBy("digest").agg(F.min(F.struct("doc", "v", "begin")).alias("least"))
    later = split.join(least, "digest").filter(F.struct("doc", "v", "begin") > F.col("least"))
    every = found.filter("digest IS NULL").unionByName(later.drop("least")).groupBy("doc", "v").agg(F.collect_list(F.struct("begin", "end")).alias("stretches"))

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: dict[str, list] = {"doc": [], "v": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"kept": []} if with_kept else {})
            for doc, v, text, places, own, stretches in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3), part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                data = _bytes(text)
                at = places.values.to_numpy().astype(np.int64)
                later = np.setdiff1d(at, np.array([f["pos"] for f in own or []], np.int64))
                low, high = _bounds(later, len(data), s)
                mark = np.zeros(len(data) + 1, np.int32)
                np.add.at(mark, low, 1)
                np.add.at(mark, high, -1)
                for x in stretches or []:
                    mark[x["begin"]] += 1
                    mark[x["end"]] -= 1
                gone = np.cumsum(mark[:-1]) > 0
                if not gone.any():
                    continue
                kept = data[~gone].tobytes()
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                for k, value in zip(out, (doc, v, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_kept else None), strict=False):
                    out[k].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(x, {"kept_sha256": pa.string(), "kept": pa.string()}.get(k, pa.int64())) for k, x in out.items()})

    joined = texts.select("doc", "v", "text", "places").join(firsts, ["doc", "v"], "left").join(every, ["doc", "v"], "left").select("doc", "v", "text", "places", "firsts", "stretches")
    return arrow(joined, remove, "doc long, v long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_kept else ""))


def passage_digest(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    text = text_of(text_column)
    own = _keyed(df.select(F.col(id_column), F.col(text_column)), id_column, text_column, _versions(df, id_column, text_column))
    lost = repeated_stretches(own.select(F.col("_doc").alias("doc"), F.col("_v").alias("v"), text.alias("text")), settings)
    rows = own.select(F.col(id_column).alias("doc_id"), F.col("_doc").alias("doc"), F.col("_v").alias("v"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("_whole"))
    out = rows.join(lost, ["doc", "v"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256"))


def without_repeats(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", settings: Settings = Settings()) -> DataFrame:
    """df with each text cut; bytes of characters that a cut has split go too."""
    versions = _versions(df, id_column, text_column)
    docs = _keyed(df.select(F.col(id_column), F.col(text_column)), id_column, text_column, versions)
    lost = repeated_stretches(docs.select(F.col("_doc").alias("doc"), F.col("_v").alias("v"), text_of(text_column).alias("text")), settings, with_kept=True)
    kept = lost.select(F.col("doc").alias("_of"), F.col("v").alias("_ver"), F.col("kept").alias("_kept"))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")  # whatever columns are called, none is lost
    rows = _keyed(df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), row), "_id", "_text", versions)
    joined = rows.join(kept, (F.col("_doc") == F.col("_of")) & (F.col("_v") == F.col("_ver")), "left")
    return joined.select(F.col("_row").withField(f"`{text_column}`", F.coalesce("_kept", f"_row.`{text_column}`")).alias("_row")).select("_row.*")
