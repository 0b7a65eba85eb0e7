from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from textmill.llm.alignment import Aligner, Tokenizers, align_texts, alignment_digest, linked_pairs
from textmill.llm.bpe_trie import byte_characters

ODD_TEXTS = ["", " ", "\n", "  x  \n\n y\t ", "a" * 30_000, "<|endoftext|> a<s></s><unk>", "a▁b", "日本語 𝒳𝒴 ß À x​", "x\x00y\x1c z\x1f   w", "tail \n", "tail  ", "\n lead", "don't  I'll\n 've 1234", "x y\n" * 50, None]


@pytest.fixture(scope="module")
def table(spark, documents):
    rows = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(ODD_TEXTS)], "doc_id long, text string")
    return documents.select("doc_id", "text").unionByName(rows).repartition(3).persist()


def brute(texts):
    """Every document's groups and links from the byte ranges of its tokens, whole text by whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = Tokenizers().paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    raw = {c: x for x, c in byte_characters().items()}
    out = []
    for text in texts:
        ranges, ids = [], []
        if text:
            whole = (" " + text).encode()
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            tokens = [[bytes(raw[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids[1])]]
            if any(b"".join(x) != whole for x in tokens):
                ids = []
        if not ids:
            out.append(([], [], [], []))
            continue
        for x in tokens:
            at, own = 0, []
            for t in x:
                own.append((at, at + len(t)))
                at += len(t)
            ranges.append(own)
        links, j = [], 0
        for i, (begin, end) in enumerate(ranges[0]):
            while ranges[1][j][1] <= begin:
                j += 1
            k = j
            while k < len(ranges[1]) and ranges[1][k][0] < end:
                links.append((ids[0][i], ids[1][k]))
                k += 1
        ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, begin = [], 0
        of = [defaultdict(list), defaultdict(list)]
        for side in (0, 1):
            g = 0
            for t, (_, e) in zip(ids[side], ranges[side], strict=True):
                of[side][g].append(t)
                g += e == ends[g]
        for g, end in enumerate(ends):
            groups.append((begin - 1, end - 1, of[0][g], of[1][g]))
            begin = end
        out.append((ids[0], ids[1], groups, links))
    return out


def digest(ids, found):
    docs, best = Counter(), Counter()
    for *_, links in found:
        docs.update(set(links))
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    rows = []
    for i, (a, b, groups, links) in zip(ids, found, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, _, x, y in groups)
        rows.append((i, len(a), len(b), len(groups), len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return rows, docs


def test_digest_and_pairs_against_brute_force(table):
    rows = table.collect()
    expected, docs = digest([x.doc_id for x in rows], brute([x.text for x in rows]))
    for block_bytes in (2_000, 16 << 20):  # many blocks, and one a task
        assert sorted(map(tuple, alignment_digest(table, block_bytes=block_bytes).collect()), key=repr) == sorted(expected, key=repr)
    assert {(x.a, x.b): x.n_docs for x in linked_pairs(table).collect()} == dict(docs)


def test_groups_against_brute_force(table):
    rows = table.filter("doc_id > 140").collect()
    expected = {repr((x.doc_id, [list(g) for g in found[2]])) for x, found in zip(rows, brute([x.text for x in rows]), strict=True)}
    assert {repr((x.doc_id, [[g.begin, g.end, list(g.a), list(g.b)] for g in x.groups])) for x in align_texts(table.filter("doc_id > 140")).collect()} == expected


def test_texts_are_whole_where_chunks_are_not_safe(table):
    own = Aligner(*Tokenizers().paths())
    assert own.by_chunk
    texts = [x.text or "" for x in table.collect()]

    def said():
        found = [[own.said[i] for i in x] for x in own.places(texts)]
        return [";".join(x) if all(x) else "" for x in found]  # a chunk whose bytes differ has no groups, so its text has none

    by_chunk = said()
    own.by_chunk = False
    own.forget()
    assert said() == by_chunk


def test_cache_is_bounded(monkeypatch):
    import textmill.llm.alignment as module

    own = Aligner(*Tokenizers().paths())
    monkeypatch.setattr(module, "CACHE_CHUNKS", 5)
    own.places(["one two three", "x" * 1000 + " four"])
    own.tidy()
    assert sorted(own.known) == [" four", " one", " three", " two"]
    assert [own.said[i] for i in own.known.values()] == own.said
    own.places(["five six seven"])
    own.tidy()
    assert not own.known


def test_empty_table(nothing):
    assert alignment_digest(nothing).collect() == []
    assert linked_pairs(nothing).collect() == []
