from __future__ import annotations

import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from textmill.llm import tokens
from textmill.llm.packing import Limits, pack, pack_documents, to_powers
from textmill.llm.token_files import Reader, Writer, token_digest

PATH = tokens.default_path()


def plain(text):
    return [*tokens.encoder(PATH, 2).library.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_encode_as_whole_texts():
    e = tokens.encoder(PATH, 2)
    assert e.by_piece
    r = random.Random(2)
    alphabet = [chr(c) for c in range(1, 0x260)] + list("'std re<|endoftext|>12  ẞΣς́")
    texts = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(600)] + ["", "it's we'll", "<|startoftext|> a", "a" * 3000]
    for text, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain(text)


def test_small_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    e = tokens.Encoder(PATH, 2)
    for text in ("a bb ccc dddd", "bb e ff ggg hh", "a a ggg"):
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == plain(text)


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        self.taken += n
        return super().read(n)


def test_reader_takes_only_what_is_asked_for():
    r = np.random.default_rng(1)
    docs = [(None if i == 0 else i, r.integers(0, 49_000, int(n))) for i, n in enumerate(r.integers(0, 3000, 200))]
    sink = io.BytesIO()
    w = Writer(sink, frame_tokens=4000)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    source = Counting(sink.getvalue())
    reader = Reader(source)
    assert reader.doc_ids == [i for i, _ in docs]
    before = source.taken
    (k, got), = reader.documents([77])
    assert k == 77 and got.tolist() == docs[77][1].tolist()
    assert source.taken - before <= int(reader.table[:, 0].max())
    assert all(got.tolist() == docs[k][1].tolist() for k, got in reader.documents())
    import zstandard

    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(sink.getvalue())
    assert whole.startswith(b"".join(ids.astype("<u2").tobytes() for _, ids in docs))


def test_damage_is_noticed():
    sink = io.BytesIO()
    w = Writer(sink, frame_tokens=10)
    for i in range(20):
        w.add(i, np.arange(7))
    w.close()
    raw = bytearray(sink.getvalue())
    reader = Reader(io.BytesIO(bytes(raw)))
    raw[-9 - 12 * len(reader.table) + 8] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError, match="damaged"):
        list(Reader(io.BytesIO(bytes(raw))).documents([0]))
    with pytest.raises(ValueError):
        Writer(io.BytesIO(), width=2).add(0, np.array([70_000]))


def test_round_trip(documents, corpus, nothing):
    got = token_digest(documents).collect()
    rows = sorted(corpus, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start, want = 0, []
    for i, text, *_ in rows:
        ids = np.array(plain(text), "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1:]) == sorted(want, key=lambda x: x[1:])
    assert token_digest(nothing).count() == 0


def test_packing_covers_every_id(documents, corpus, nothing):
    rows = pack_documents(documents, with_ids=True).collect()
    assert pack_documents(nothing).count() == 0
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        total = 0
        for r in own:
            assert r["offset"] == total and len(r["ids"]) == r["length"] > 0
            total += r["length"]
        assert total <= 4096 and total & (total - 1) == 0
    want = defaultdict(list)
    for i, text, *_ in corpus:
        want[i] += plain(text)
    for i, ids in want.items():
        own = sorted(docs[i], key=lambda r: r["start"])
        assert sorted(x for r in own for x in r["ids"]) == sorted(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    again = pack_documents(documents).collect()
    assert sorted(map(tuple, again), key=repr) == sorted((tuple(r)[:-1] for r in rows), key=repr)


def test_short_documents_fill_their_sequences(spark):
    """Documents of ten to forty-nine words in many blocks of one task: every sequence is full but those that the very last bin is split into."""
    import textmill.llm.packing as module

    r = np.random.default_rng(6)
    texts = [(i, " ".join(["word"] * int(r.integers(10, 50)))) for i in range(4500)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = pack_documents(df).collect()
    total = sum(len(x.split()) + 1 for _, x in texts)
    sizes = defaultdict(int)
    for row in rows:
        sizes[row["sequence_id"]] += row["length"]
    assert sum(sizes.values()) == total
    assert len(sizes) == total // 4096 + (total % 4096).bit_count()
    assert len(rows) <= 4500 + len(sizes)  # hardly a document is cut
    # more documents than segments: such bins stay as they are
    few = [(i, "") for i in range(module.Limits().segments * 3 + 5)]
    sizes = defaultdict(int)
    for row in pack_documents(spark.createDataFrame(few, "doc_id long, text string").coalesce(1)).collect():
        sizes[row["sequence_id"]] += row["length"]
    assert sorted(sizes.values()) == [1, 4, *[module.Limits().segments] * 3]


@pytest.mark.parametrize("cut", [True, False])
def test_bins_keep_all_limits(cut):
    r = np.random.default_rng(4)
    tokens_ = r.integers(1, 400 if cut else 100, 300)
    loss = np.minimum(tokens_, r.integers(0, 60, 300))
    limits = Limits(100, 5, 60)
    covered = defaultdict(list)
    bins = pack(tokens_, loss, limits, cut)
    for own in bins:
        assert sum(n for _, _, n in own) <= 100 and len(own) <= 5
        bearing = sum(max(0, at + n - max(at, tokens_[i] - loss[i])) for i, at, n in own)
        assert bearing <= 60
        for i, at, n in own:
            covered[i].append((at, n))
    for i, n in enumerate(tokens_):
        at = 0
        for a, k in sorted(covered[i]):
            assert a == at
            at += k
        assert at == n and (cut or len(covered[i]) == 1)
    if not cut:
        with pytest.raises(ValueError):
            pack(np.array([101]), np.array([0]), limits, cut=False)


def test_powers():
    parts = to_powers([(0, 5, 3), (1, 0, 10)])
    assert [sum(x[2] for x in p) for p in parts] == [8, 4, 1] and [x for p in parts for x in p] == [(0, 5, 3), (1, 0, 5), (1, 5, 4), (1, 9, 1)]
