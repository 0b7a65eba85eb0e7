"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is: one zstandard frame after the other, each holding whole documents' ids (little-endian,
2 or 4 bytes each); a skippable frame with the documents' index (ids, numbers of tokens, numbers of
documents in each frame), itself compressed; a skippable frame with the seek table of the public
seekable format (compressed size, content size and xxh64 checksum of each frame).  A reader fetches
the last bytes, the seek table and the index, and then decompresses only the frames that hold the
requested documents; each frame's checksum is compared before its ids are used.

Null text: only the end id.  Null id: kept, ordered first.  Rows with the same id: all kept, in the
order of their texts.  Empty table: no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import arrow, open_fs, saved, scratch, text_of
from textmill.llm.tokens import batches, default_path, encoder

#: Fixed values of the public seekable format.
SEEK_MAGIC, SKIP_MAGIC, INDEX_MAGIC = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
HAS_CHECKSUM = 0x80
#: Ids after which a frame ends; a longer document ends the frame that holds what came before it.
FRAME_TOKENS = 32_768


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Writer:
    """Writes documents in the order given; close() adds index and seek table."""

    def __init__(self, sink, width: int = 2, frame_tokens: int = FRAME_TOKENS, level: int = 1):
        import zstandard

        self.sink, self.width, self.frame_tokens = sink, width, frame_tokens
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.n_held = self.n_docs = 0
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.in_frame: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= 1 << (8 * self.width):
            raise ValueError(f"an id needs more than {self.width} bytes")
        self.held.append(ids.astype(f"<u{self.width}").tobytes())
        self.docs.append((doc_id, len(ids)))
        self.n_docs += 1
        self.n_held += len(ids)
        if self.n_held >= self.frame_tokens:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        content = b"".join(self.held)
        packed = self.press.compress(content)
        self.sink.write(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.in_frame.append(self.n_docs)
        self.held, self.n_held, self.n_docs = [], 0, 0

    def close(self) -> None:
        if self.n_docs:
            self._flush()
        known = np.array([x is not None for x, _ in self.docs], dtype=np.uint8)
        ids = np.array([x or 0 for x, _ in self.docs], dtype="<i8")
        index = struct.pack("<BQQ", self.width, len(self.docs), len(self.in_frame)) + known.tobytes() + ids.tobytes()
        index += np.array([n for _, n in self.docs], dtype="<u4").tobytes() + np.array(self.in_frame, dtype="<u4").tobytes()
        self.sink.write(_skippable(INDEX_MAGIC, packed := self.press.compress(index)))
        table = b"".join(struct.pack("<III", *x) for x in self.entries)
        self.sink.write(_skippable(SKIP_MAGIC, table + struct.pack("<IBI", len(self.entries), HAS_CHECKSUM, SEEK_MAGIC)))
        self.index_bytes = len(packed) + 8


class Reader:
    """Random access to the documents of one file; source: a seekable binary file."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUM:
            raise ValueError("no seek table with checksums at the end of this file")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.begins = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        start, end = int(self.begins[-1]), size - 9 - 12 * n - 8
        magic, length = struct.unpack("<II", self._at(start, 8))
        if magic != INDEX_MAGIC or start + 8 + length != end:
            raise ValueError("the index of documents is damaged")
        index = self.unpack.decompress(self._at(start + 8, length))
        self.width, n_docs, n_frames = struct.unpack_from("<BQQ", index)
        at = 17
        known = np.frombuffer(index, np.uint8, n_docs, at)
        ids = np.frombuffer(index, "<i8", n_docs, at + n_docs)
        self.doc_ids = [int(i) if k else None for k, i in zip(known, ids, strict=True)]
        self.lengths = np.frombuffer(index, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
        frames = np.frombuffer(index, "<u4", n_frames, at + 13 * n_docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.frame_of = np.repeat(np.arange(n_frames), frames)
        self.first_of = np.concatenate([[0], np.cumsum(frames)])

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        packed, plain, check = (int(x) for x in self.table[k])
        content = self.unpack.decompress(self._at(int(self.begins[k]), packed), max_output_size=plain)
        if len(content) != plain or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(content, f"<u{self.width}")

    def documents(self, wanted: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the file, ids) of the wanted places in ascending order (None: all); each frame is decompressed once, others never."""
        last, ids = -1, None
        for i in range(len(self.lengths)) if wanted is None else sorted(wanted):
            k = int(self.frame_of[i])
            if k != last:
                last, ids = k, self.frame(k)
            begin = int(self.starts[i] - self.starts[self.first_of[k]])
            yield i, ids[begin : begin + int(self.lengths[i])]


def write_token_files(
    df: DataFrame, out: str, *, id_column: str = "doc_id", text_column: str = "text",
    tokenizer_path: str | None = None, end_id: int | None = 2, width: int = 2, frame_tokens: int = FRAME_TOKENS,
) -> DataFrame:
    """Writes one file for each range of ids under `out`; returns a row for each file: part, path, n_docs, n_tokens.

    Files in order of `part` hold the documents in ascending order of ids.  A task writes beside its
    final name and renames, so a task that runs again replaces its file by an equal one.
    """
    path = tokenizer_path or default_path()

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out)
        task = TaskContext.get()
        encode = encoder(path, end_id).encode
        name, writer, sink, total = f"{root}/part-{task.partitionId():06d}.tokz", None, None, 0
        own = f"{name}.{task.taskAttemptId()}.tmp"
        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for i, j in batches(texts):
                for doc, raw in zip(ids[i:j], encode(texts[i:j]), strict=True):
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        sink = fs.open_output_stream(own)
                        writer = Writer(sink, width, frame_tokens)
                    tokens = np.frombuffer(raw, "<u4")
                    writer.add(doc, tokens)
                    total += len(tokens)
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [name], "n_docs": [len(writer.docs)], "n_tokens": [total]})

    rows = df.select(F.col(id_column).cast("long").alias("_id"), text_of(text_column).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    # rows with one id, such as null, are dealt to several files
    ordered = rows.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h", "_text").select("_id", "_text")
    return saved(arrow(ordered, write, "part long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """Reads all documents of the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row for each file, so its running sum is taken on the driver.
    """
    spark = manifest.sparkSession
    files, start = [], 0
    for r in sorted(manifest.collect()):
        files.append((r.path, start))
        start += r.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(out)
        for part in parts:
            for name, base in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                with fs.open_input_file(name) as source:
                    reader = Reader(source)
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.documents()]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(reader.doc_ids, pa.int64()),
                            "start": pa.array(reader.starts + base, pa.int64()),
                            "n_tokens": pa.array(reader.lengths, pa.int64()),
                            "ids_crc32": pa.array(crcs, pa.int64()),
                        }
                    )

    rows = spark.createDataFrame(files, "path string, base long").repartition(min(len(files), 10_000))
    return arrow(rows, read, schema)


def token_digest(df: DataFrame, **options) -> DataFrame:
    """Round trip: writes df's texts to files in the shared folder and reads every document from them."""
    out = scratch(df.sparkSession, "token-files")
    return read_token_files(write_token_files(df, out, **options), out)
