"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers encode a text; each byte of it gets a label: no token ends there, one of A ends, one of
B ends, or both.  A regular expression scans that label string and extracts the spans up to each
both-label; how many A-ends and B-ends a span has says which tokens form a group.  Tokens of the two
sides whose byte ranges overlap are linked: one link for each label that is not empty, between the
tokens that cover its byte.

Neither tokenizer joins a blank with what stands before it, nor a Latin letter with a sign, digit or
white space behind it, so both end a token there, whatever the words are: a text is cut at such places
into chunks, and each distinct chunk is encoded, labelled and scanned once (many together, as one text),
then kept in a bounded cache of the worker.  That holds for byte-level tokenizers with the common
splitting pattern and for piece vocabularies without pieces that span such a place; for others the whole
text is one chunk.

How many documents hold an id pair linked is counted over the corpus: a task forms blocks of documents,
counts each pair of a block once a document, and sends one row for each pair of a block.  The counts
come back to the blocks by a join on pairs, and a block's documents, kept as lists of chunks, meet them
in a cogroup.  No link of a single occurrence is ever shuffled, a block is bounded by `block_bytes` (or
one text), and the window that finds an A id's highest count holds at most B's vocabulary.

Texts that are null or empty, or whose joined token bytes on either side differ from the text's own (a
blank in front): no tokens, zeros, empty string.  Repeated rows count each.  Ties: every pair with the
highest count of its A id is a best one.  Null ids: rows like others.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.bpe_trie import byte_characters
from textmill.llm.common import arrow, claim, free, saved, text_of, trim


@dataclass(frozen=True)
class Tokenizers:
    """Paths of A (a `tokenizers` file of byte-level BPE) and B (a `sentencepiece` model that adds a blank)."""

    a: str | None = None
    b: str | None = None

    def paths(self) -> tuple[str, str]:
        import public_tokenizers

        return self.a or str(public_tokenizers.path("byte_bpe_50k.json")), self.b or str(public_tokenizers.path("piece_bpe_32k.model"))


#: Labels of a byte: nothing ends, A ends, B ends, both end.
NONE, A_END, B_END, BOTH = b".abx"
LABELS = bytes.maketrans(bytes(range(4)), bytes([NONE, A_END, B_END, BOTH]))
SPAN = re.compile(rb"[^x]*x")
#: Letters behind which, unless another letter follows, both tokenizers end a token.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: A chunk: up to a blank behind anything else, or to what is no letter behind one of LETTERS.  The first two forms are the last one's usual cases.
CHUNK = re.compile(rf"\s*+[^{LETTERS}\s]*+[{LETTERS}]++(?=[\W\d_]|\Z)|\s*+[^{LETTERS}\s]++(?= |\Z)|(?s:.(?:(?!(?<=[{LETTERS}])[\W\d_]|(?<=\S) ).)*)")
#: Goes before a chunk that doesn't begin with a blank, where chunks are encoded together.
CARRIER = " a"
#: The mark that piece vocabularies write for a blank.
MARK = "▁"
#: Bytes of text in a block; chunks that a worker keeps, and bytes of the longest of them; bytes encoded as one text.
BLOCK_BYTES, CACHE_CHUNKS, LONG_CHUNK, AT_ONCE = 16 << 20, 250_000, 400, 1 << 16
#: Chunks that are counted at a time.
SLICE = 200_000
#: Bits of a pair that hold B's id; bits of a block's number that count within a task.
B_BITS, BLOCK_BITS = 32, 24


class Spans(dict):
    """Of a span of labels: how many tokens of A and of B it ends."""

    def __missing__(self, span: bytes) -> tuple[int, int]:
        both = span.count(BOTH)
        found = self[span] = span.count(A_END) + both, span.count(B_END) + both
        return found


class Aligner:
    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        made = json.loads(self.a.to_str())
        pre, raw = made.get("pre_tokenizer") or {}, {c: x for x, c in byte_characters().items()}
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for x, i in names.items():
            self.a_bytes[i] = bytes(raw[c] for c in x) if all(c in raw for c in x) else x.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.by_chunk = (
            made.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex")
            and not pre.get("add_prefix_space")
            and not any(re.search(f"[^{MARK}]{MARK}|[{LETTERS}][^{LETTERS}]", x) for i, x in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        )
        self.a_said, self.b_said = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        self.spans = Spans()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups = array("q"), array("q"), array("q")  # no groups: the chunk's bytes differ
        self.said: list[str] = []
        self.links: list[bytes] = []

    def labels(self, text: str) -> tuple[list[int], list[int], np.ndarray] | None:
        """A's ids, B's ids and each byte's label (0 to 3) of a text with its blank in front; None where the bytes differ."""
        raw = text.encode()
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:], num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        label = np.zeros(len(raw), np.uint8)
        label[np.cumsum(self.a_length[a]) - 1] |= 1
        label[np.cumsum(self.b_length[b]) - 1] |= 2
        return a, b, label

    def _learn(self, chunks: list[str]) -> None:
        """Encodes, labels and scans chunks as one text, and keeps what belongs to each."""
        together = [x if x[0] == " " else CARRIER + x for x in chunks] if self.by_chunk else chunks
        found = self.labels("".join(together))
        sizes = np.array([len(x.encode()) for x in together])
        ends = np.cumsum(sizes) - 1
        # carriers end where both sides end, like chunks; what belongs to them is left out
        begins = ends - [len(x.encode()) for x in chunks]
        if found is None or (found[2][ends] != 3).any() or (found[2][begins[begins >= 0]] != 3).any():
            if len(chunks) > 1:
                half = len(chunks) // 2
                self._learn(chunks[:half])
                self._learn(chunks[half:])
                return
            found, ends, begins = ([], [], np.zeros(1, np.uint8)), np.zeros(1, np.int64), np.full(1, -1)
        a, b, label = found
        groups, i, j, a_said, b_said = [], 0, 0, list(map(self.a_said.__getitem__, a)), list(map(self.b_said.__getitem__, b))
        for n, m in map(self.spans.__getitem__, SPAN.findall(label.tobytes().translate(LABELS))):
            groups.append(f"{a_said[i] if n == 1 else ','.join(a_said[i : i + n])}|{b_said[j] if m == 1 else ','.join(b_said[j : j + m])}")
            i, j = i + n, j + m
        at = np.flatnonzero(label)
        of_a, of_b = label[at] & 1, label[at] >> 1
        links = (np.array(a, np.int64)[np.cumsum(of_a, dtype=np.int64) - of_a] << B_BITS | np.array(b, np.int64)[np.cumsum(of_b, dtype=np.int64) - of_b]).tobytes()

        def between(what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """How many of these labels stand before each chunk, and up to its end."""
            total = np.concatenate([[0], np.cumsum(what, dtype=np.int64)])
            return total[begins + 1], total[ends + 1]

        self.known.update(zip(chunks, range(len(self.said), len(self.said) + len(chunks)), strict=True))
        for kept, what in ((self.n_a, label & 1), (self.n_b, label >> 1), (self.n_groups, label == 3)):
            before, after = between(what)
            kept.frombytes((after - before).tobytes())
        self.said += [";".join(groups[x:y]) for x, y in zip(*(x.tolist() for x in between(label == 3)), strict=True)]
        self.links += [links[8 * x : 8 * y] for x, y in zip(*(x.tolist() for x in between(label > 0)), strict=True)]

    def places(self, texts: list[str]) -> list[list[int]]:
        """Of each text the places of its chunks in what is kept."""
        split = [CHUNK.findall(" " + x) if self.by_chunk else [" " + x] if x else [] for x in texts]
        split = [x if t else [] for x, t in zip(split, texts, strict=True)]
        some, held = [], 0
        for x in set().union(*split).difference(self.known):
            some.append(x)
            held += len(x)
            if held >= AT_ONCE or not self.by_chunk:
                self._learn(some)
                some, held = [], 0
        if some:
            self._learn(some)
        get = self.known.__getitem__
        return [list(map(get, x)) for x in split]

    def tidy(self) -> None:
        """Between blocks: the cache stays bounded."""
        if len(self.known) > CACHE_CHUNKS or any(len(x) > LONG_CHUNK for x in self.known):
            kept = [x for x in self.known if len(x) <= LONG_CHUNK] if len(self.known) <= CACHE_CHUNKS else []
            old = self.known, self.n_a, self.n_b, self.n_groups, self.said, self.links
            self.forget()
            for x in kept:
                i = old[0][x]
                self.known[x] = len(self.said)
                for own, before in zip((self.n_a, self.n_b, self.n_groups, self.said, self.links), old[1:], strict=True):
                    own.append(before[i])


@lru_cache(maxsize=1)
def _made(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def aligner(a: str, b: str) -> Aligner:
    """One per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    claim("alignment", _made.cache_clear)
    return _made(a, b)


#: Rows of three kinds: a document (pair is null, n is null), a pair of a block (how many of its documents hold it), a block's chunks.
BLOCKS = "block long, at int, pair long, n long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks binary"
_KINDS = dict(zip([x.split()[0] for x in BLOCKS.split(", ")], [pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.binary()], strict=True))


def _rows(count: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kind) if k in columns else pa.nulls(count, kind) for k, kind in _KINDS.items()], names=list(_KINDS))


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, so many of each."""
    if not len(begin):
        return np.zeros(0, np.int64)
    return np.arange(int(length.sum())) + np.repeat(begin - (np.cumsum(length) - length), length)


def _block(align: Aligner, number: int, ids: list, places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its documents (their chunks as numbers within the block), its pairs, its chunks' pairs."""
    n_a, n_b, n_groups = (np.frombuffer(x, np.int64) for x in (align.n_a, align.n_b, align.n_groups))
    good = [not len(x) or bool(n_groups[x].all()) for x in places]
    places = [x if ok else x[:0] for x, ok in zip(places, good, strict=True)]
    flat = np.concatenate(places) if places else np.zeros(0, np.int64)
    used, local = np.unique(flat, return_inverse=True)
    links = [align.links[i] for i in used]
    n_links = np.array([len(x) // 8 for x in links], np.int64)
    begin = np.cumsum(n_links) - n_links
    pairs, pair_of = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
    holds = np.zeros(len(pairs), np.int64)
    lengths = np.array([len(x) for x in places], np.int64)
    ends = np.cumsum(lengths)
    said = [hashlib.sha256(";".join(map(align.said.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "" for x in places]
    sums = []
    for n in (n_a[flat], n_b[flat], n_groups[flat], n_links[local]):
        total = np.concatenate([[0], np.cumsum(n)])
        sums.append(total[ends] - total[ends - lengths])
    chunks, i = [], 0
    while i < len(places):  # so many documents at a time that the arrays stay small
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, side="right")))
        own = local[ends[i] - lengths[i] : ends[j - 1]]
        document, chunk = np.divmod(np.sort(np.repeat(np.arange(j - i), lengths[i:j]) * max(len(used), 1) + own), max(len(used), 1))
        starts = np.diff(document, prepend=-1) > 0
        step = np.where(starts, chunk, np.diff(chunk, prepend=0))
        raw, stops = step.astype(np.uint32).tobytes(), 4 * (ends[i:j] - (ends[i] - lengths[i]))
        chunks += [raw[x - 4 * n : x] for x, n in zip(stops.tolist(), lengths[i:j].tolist(), strict=True)]
        new = starts | (step > 0)
        mine = chunk[new]
        key = np.repeat(document[new], n_links[mine]) * max(len(pairs), 1) + pair_of[_ranges(begin[mine], n_links[mine])]
        key.sort()
        holds += np.bincount(key[np.diff(key, prepend=-1) > 0] % max(len(pairs), 1), minlength=len(pairs))[: len(pairs)]
        i = j
    yield _rows(len(ids), block=[number] * len(ids), at=range(len(ids)), doc_id=ids, n_a=sums[0], n_b=sums[1], n_groups=sums[2], n_links=sums[3], groups_sha256=said, chunks=chunks)
    if len(pairs):
        step = 100_000
        for k in range(0, len(pairs), step):
            some = pairs[k : k + step]
            yield _rows(len(some), block=np.full(len(some), number), at=np.arange(k, k + len(some), dtype=np.int32), pair=some, n=holds[k : k + step])
        yield _rows(1, block=[number], n=[len(pairs)], chunks=[n_links.astype(np.uint32).tobytes() + pair_of.astype(np.uint32).tobytes()], at=[len(used)])


def blocks(df: DataFrame, tokenizers: Tokenizers, block_bytes: int) -> DataFrame:
    """BLOCKS of a table _id, _text."""
    a, b = tokenizers.paths()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a, b)
        number, ids, places, held = TaskContext.get().partitionId() << BLOCK_BITS, [], [], 0
        for part in parts:
            own, texts, i = part.column(0).to_pylist(), part.column(1).to_pylist(), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and size < min(1 << 20, block_bytes):
                    size += len(texts[j])
                    j += 1
                ids += own[i:j]
                places += [np.array(x, np.int32) for x in align.places(texts[i:j])]
                held, i = held + size, j
                if held >= block_bytes:
                    yield from _block(align, number, ids, places)
                    number, ids, places, held = number + 1, [], [], 0
                    align.tidy()
        if ids:
            yield from _block(align, number, ids, places)
            align.tidy()

    return arrow(df, run, BLOCKS)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, n_docs, best (whether no pair of its A id has more documents) of the whole table that blocks() made."""
    counts = made.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n_docs"))
    highest = F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", B_BITS)))
    return counts.select("pair", "n_docs", (F.col("n_docs") == highest).alias("best"))


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links; pairs: the block's, with their counts."""
    at = pairs.column("place").to_numpy()
    n_docs, best = np.zeros((2, len(at)), np.int64)
    n_docs[at], best[at] = pairs.column("n_docs").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    is_document = documents.column("n").is_null()
    rows, head = documents.filter(is_document), documents.filter(documents.column("n").is_valid())
    if head.num_rows:
        raw, n = np.frombuffer(head.column("chunks")[0].as_py(), np.uint32).astype(np.int64), head.column("at")[0].as_py()
        ends = np.cumsum(raw[:n])
        # over a chunk's links: the sum of counts and the number of best ones, as differences of running sums
        of_chunk = [np.concatenate([[0], np.cumsum(x[raw[n:]])]) for x in (n_docs, best)]
        of_chunk = [x[ends] - x[ends - raw[:n]] for x in of_chunk]
    sums = [[], []]
    for x in rows.column("chunks"):
        own = np.cumsum(np.frombuffer(x.as_py(), np.uint32).astype(np.int64))
        for out, value in zip(sums, of_chunk if len(own) else (np.zeros(0, np.int64),) * 2, strict=True):
            out.append(int(value[own].sum()) if len(own) else 0)
    out = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return out.add_column(5, "n_best", pa.array(sums[1], pa.int64())).add_column(6, "count_sum", pa.array(sums[0], pa.int64()))


def _input(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("_id"), text_of(text_column).alias("_text"))


def alignment_digest(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", tokenizers: Tokenizers = Tokenizers(), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """DIGEST of every row."""
    made = saved(blocks(_input(df, id_column, text_column), tokenizers, block_bytes), "token-alignment")
    back = made.filter("pair IS NOT NULL").select("block", "at", "pair").join(pair_counts(made), "pair").select(F.col("block").alias("of_block"), F.col("at").alias("place"), "n_docs", "best")
    documents = made.filter("pair IS NULL").select("block", "at", "n", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunks")

    def run(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        out = _counted(documents, pairs)
        trim()
        return out

    return documents.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(run, DIGEST)


def linked_pairs(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", tokenizers: Tokenizers = Tokenizers(), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a, b, n_docs, best: every id pair that some document holds linked, as a map from A's vocabulary to B's."""
    made = saved(blocks(_input(df, id_column, text_column), tokenizers, block_bytes), "token-alignment")
    out = pair_counts(made).select(F.shiftright("pair", B_BITS).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).cast("int").alias("b"), "n_docs", "best")
    out = saved(out, "token-pairs")
    free(made)
    return out


GROUPS = "doc_id long, groups array<struct<begin: int, end: int, a: array<int>, b: array<int>>>"


def align_texts(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", tokenizers: Tokenizers = Tokenizers()) -> DataFrame:
    """GROUPS of every row: the byte range of each group (in the text's own UTF-8; the blank in front is at -1) and its tokens' ids on both sides."""
    a, b = tokenizers.paths()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a, b)
        for part in parts:
            for i, text in enumerate(part.column(1).to_pylist()):
                found, own = align.labels(" " + text) if text else None, []
                if found:
                    at, k, j = -1, 0, 0
                    for span in SPAN.findall(found[2].tobytes().translate(LABELS)):
                        n, m = align.spans[span]
                        own.append({"begin": at, "end": at + len(span), "a": found[0][k : k + n], "b": found[1][j : j + m]})
                        at, k, j = at + len(span), k + n, j + m
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, 1), pa.array([own], kind)], names=["doc_id", "groups"])

    return arrow(_input(df, id_column, text_column), run, GROUPS)
