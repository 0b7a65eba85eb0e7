"""Vector bin packing of token sequences.

Every example is a vector: tokens, segments (always 1) and loss-bearing tokens.  A bin has a limit
for each.  The open bin takes, again and again, the example that fits and whose vector has the
largest dot product with what the bin has left (both as shares of the limits); the demand of scarce
dimensions so draws examples that use them in the same proportion.  Where examples may be cut, the
first part of the next one fills a bin that nothing fits.

A task packs its own rows in blocks of bounded size; no row moves.  What a block's last bin holds goes
into the next block; only a task's very last bin is split into bins whose lengths are powers of two,
which need no padding.  A bin that another limit than that on tokens has closed stays as it is, and is
padded.  Equal scores: the first example wins.  Empty table: no rows.  Sequence ids are the task's number, shifted, plus a count: unique
over the table and equal on every run over the same files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import arrow, text_of
from textmill.llm.tokens import CACHE_PIECES, batches, default_path, encoder

#: Bits of a sequence id that count within a task.
TASK_SHIFT = 40


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 512
    loss_tokens: int = 4096


#: Examples considered together; memory and time of a block are bounded by these.
BLOCK_EXAMPLES, BLOCK_TOKENS = 2048, 4_000_000


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Bins of (example, begin, length).

    tokens, loss: per example; with `cut`, loss-bearing tokens are the last `loss` ones of an example,
    and an example longer than a bin gives whole bins first.  Without `cut`, an example that no empty
    bin can hold raises ValueError: dropping it is the caller's decision.
    """
    n = len(tokens)
    begin, left, bearing = np.zeros(n, np.int64), tokens.astype(np.int64).copy(), np.minimum(loss, tokens).astype(np.int64).copy()
    bins: list[list[tuple[int, int, int]]] = []
    if not cut and n and (left.max() > limits.tokens or bearing.max() > limits.loss_tokens):
        raise ValueError("an example is larger than a sequence and may not be cut")
    alive = left > 0
    if cut and limits.loss_tokens >= limits.tokens:
        for i in np.flatnonzero(left > limits.tokens):  # whole bins of one example each
            while left[i] > limits.tokens:
                bins.append([(int(i), int(begin[i]), limits.tokens)])
                begin[i] += limits.tokens
                left[i] -= limits.tokens
                bearing[i] = min(bearing[i], left[i])
    order = np.flatnonzero(alive)
    while len(order):
        room, slots, losses, own = limits.tokens, limits.segments, limits.loss_tokens, []
        while room and slots and len(order):
            t, b = left[order], bearing[order]
            fits = (t <= room) & (b <= losses)
            if fits.any():
                score = t * (room / limits.tokens**2) + b * (losses / limits.loss_tokens**2) + (slots / limits.segments**2)
                at = int(np.argmax(np.where(fits, score, -1.0)))
                take = int(t[at])
            elif cut:
                at = int(np.argmax(t))
                take = min(room, int(t[at]) - int(b[at]) + losses)
                if take <= 0:
                    break
            else:
                break
            i = int(order[at])
            own.append((i, int(begin[i]), take))
            carried = max(0, take - (int(left[i]) - int(bearing[i])))
            begin[i] += take
            left[i] -= take
            bearing[i] -= carried
            room, slots, losses = room - take, slots - 1, losses - carried
            if not left[i]:
                order = np.delete(order, at)
        bins.append(own)
    return bins


def to_powers(own: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One bin as bins whose lengths are the powers of two in the binary form of its length."""
    total, out = sum(x[2] for x in own), []
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            room, part = 1 << bit, []
            while room:
                i, at, n = own[0]
                part.append((i, at, min(n, room)))
                own = own[1:] if n <= room else [(i, at + room, n - room), *own[1:]]
                room -= min(n, room)
            out.append(part)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", loss_column: str | None = None,
    limits: Limits = Limits(), tokenizer_path: str | None = None, end_id: int | None = 2, with_ids: bool = False,
    cache_pieces: int = CACHE_PIECES, batch_bytes: int = 4 << 20,
) -> DataFrame:
    """Packs every row's tokens; one row for each piece.

    loss_column: how many of the last tokens bear loss (null or no column: all).  With `with_ids` the
    piece's ids come along as column `ids`.  Null text: only the end id.  Repeated rows are packed
    each; rows with a null id too.  cache_pieces and batch_bytes trade a worker's memory for time.  A row without any token (no end id, empty text) has no piece.
    """
    path = tokenizer_path or default_path()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def flush(block: list[tuple[int | None, bytes, int | None, int]], base: int, last: bool) -> tuple[pa.RecordBatch, int, list]:
        """The rows of a block's bins, the next sequence id, and what the next block begins with."""
        tokens = np.array([len(x[1]) // 4 for x in block], np.int64)
        begun = np.array([x[3] for x in block], np.int64)
        loss = np.array([n if x[2] is None else x[2] for x, n in zip(block, tokens, strict=True)], np.int64)
        bins = [[(i, int(begun[i]) + at, n) for i, at, n in own] for own in pack(tokens - begun, loss, limits, cut=True)]
        rest = bins.pop() if bins and sum(x[2] for x in bins[-1]) < limits.tokens and len(bins[-1]) < limits.segments else []
        # a bin that isn't full has no part but the last of any example
        kept = [(*block[i][:3], at) for i, at, _ in rest]
        if last and rest:
            bins += to_powers(rest)
        rows: list[list] = [[] for _ in range(7 + with_ids)]
        for k, own in enumerate(bins):
            offset = 0
            for i, at, n in own:
                raw = block[i][1][4 * at : 4 * (at + n)]
                values = [block[i][0], at, n, zlib.crc32(raw), int(tokens[i]), base + k, offset]
                for column, v in zip(rows, values + [np.frombuffer(raw, "<i4")] * with_ids, strict=True):
                    column.append(v)
                offset += n
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")]), base + len(bins), kept

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id, cache_pieces).encode
        base, block, held = TaskContext.get().partitionId() << TASK_SHIFT, [], 0
        for part in parts:
            ids, texts, losses = (part.column(k).to_pylist() for k in range(3))
            for i, j in batches(texts, batch_bytes):
                for x in zip(ids[i:j], encode(texts[i:j]), losses[i:j], strict=True):
                    block.append((*x, 0))
                    held += len(x[1]) // 4
                    if len(block) >= BLOCK_EXAMPLES or held >= BLOCK_TOKENS:
                        out, base, block = flush(block, base, False)
                        yield out
                        held = sum(len(x[1]) // 4 - x[3] for x in block)
        if block:
            yield flush(block, base, True)[0]

    loss = F.lit(None).cast("long") if loss_column is None else F.greatest(F.col(loss_column).cast("long"), F.lit(0))
    return arrow(df.select(F.col(id_column).cast("long").alias("_id"), text_of(text_column).alias("_text"), loss.alias("_loss")), run, schema)
