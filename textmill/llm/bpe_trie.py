"""BPE encoding by a walk over a trie of distinct words, and decoding.

The encoding of a prefix is known from the encodings of shorter prefixes: its last token is the one
vocabulary entry that ends there, stands unmerged by itself, and lies next to the last token of what
comes before it without any merge across the border.  So a trie node needs one number, its last token,
and words that share a prefix share all of that prefix's work.

A worker takes the distinct words of a batch of texts, inserts them into a trie in sorted order, which
is the trie's depth-first order, and lets the states of the present path (the last tokens of all its
prefixes) go down to the new nodes; only that path is held.  A word's last symbol is another one than
the same byte inside a word where the vocabulary marks word ends, so an end is a node of its own.  Words
seen before come from a bounded cache.  Texts, cut by the tokenizer's own normaliser and splitter, are
joined from their words' ids.

Whether two tokens may stand side by side follows from the merges alone: along the right edge of the
left token's merge tree and the left edge of the right one's, some pair merges across the border if its
rank is below the ranks at which both are used up.  This needs a vocabulary each of whose entries is
made by one merge, of parts made earlier; others are refused with ValueError.

Null text: empty, no tokens.  A text may be of any length, also as a single word: time is linear in it.
Special tokens' strings in a text become those tokens, as in the library.  Repeated rows, ties of any
kind and null ids: a row each.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import arrow, claim, text_of
from textmill.llm.tokens import NORMALIZERS, ODD, PIECE, SPLIT, batches, default_path

#: Words and token pairs that a worker keeps (memory only, never results).
CACHE_WORDS, CACHE_PAIRS = 450_000, 600_000
#: Bytes of text whose distinct words go into one trie.
BATCH_BYTES = 4 << 20


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, and which of them may stand side by side."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE models are supported")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.size = max(self.ids.values()) + 1
        self.rank: dict[int, int] = {}  # of a pair of tokens, as left * size + right
        self.parts: dict[int, tuple[int, int, int]] = {}  # rank, left, right
        for at, merge in enumerate(model["merges"]):
            left, right = (self.ids[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            made = self.ids["".join(merge.split(" ") if isinstance(merge, str) else merge)]
            if made in self.parts or any(x in self.parts and self.parts[x][0] >= at for x in (left, right)):
                raise ValueError("a token is made by two merges, or used before it is made")
            self.rank[left * self.size + right] = at
            self.parts[made] = at, left, right
        letters = byte_characters().values()
        self.symbols = {x: self._symbols(x) for x in self.ids}
        if any(x + end not in self.ids for x in letters for end in {"", self.suffix}) or any(n > 1 for x, n in self.symbols.items() if self.ids[x] not in self.parts):
            raise ValueError("the vocabulary lacks some byte, or a longer token has no merge")
        self.lengths = [0] * self.size
        for x, i in self.ids.items():
            self.lengths[i] = self.symbols[x]
        self.tails = self._tails()
        self.alone: dict[int, bool] = {}
        self.together: dict[int, bool] = {}

    def _symbols(self, token: str) -> int:
        return len(token) - len(self.suffix) if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else len(token)

    def _tails(self) -> dict[str, tuple[int, ...]]:
        """For the last three symbols of a token, word end included: how many symbols the tokens have that end so, falling, and then the two lengths without three."""
        found: dict[str, set[int]] = {}
        for x, n in self.symbols.items():
            if n >= 3:
                found.setdefault(x[n - 3 :], set()).add(n)
        return {x: (*sorted(n, reverse=True), 2, 1) for x, n in found.items()}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along the left (1) or right (2) edge of a merge tree, each with the rank that uses it up."""
        out, used = [(token, inf)], inf
        while token in self.parts:
            used, token = self.parts[token][0], self.parts[token][side]
            out.append((token, used))
        return out

    def _border(self, left: int, right: int, below: float) -> bool:
        """Whether no merge of rank less than `below` happens across the border of two tokens."""
        for u, u_used in self._edge(left, 2):
            for v, v_used in self._edge(right, 1):
                q = self.rank.get(u * self.size + v, inf)
                # of equal ranks the leftmost pair goes first
                if q < below and q < u_used and q <= v_used:
                    return False
        return True

    def stands(self, token: int) -> bool:
        """Whether the token's own characters are encoded as this token."""
        if token not in self.alone:
            at, left, right = self.parts.get(token, (0, -1, -1))
            self.alone[token] = left < 0 or (self.stands(left) and self.stands(right) and self._border(left, right, at))
        return self.alone[token]

    def beside(self, left: int, right: int) -> bool:
        """Whether two tokens that stand alone stay as they are side by side; kept in `together`."""
        if len(self.together) >= CACHE_PAIRS:
            self.together.clear()
        found = self.together[left * self.size + right] = self.stands(right) and self._border(left, right, inf)
        return found


def encode_words(vocabulary: Vocabulary, words: list[str]) -> Iterator[tuple[str, list[int]]]:
    """(word, ids) of distinct words in byte characters, in the depth-first order of their trie; no word is empty."""
    ids, suffix, lengths, size, tails, together, beside, stands = vocabulary.ids, vocabulary.suffix, vocabulary.lengths, vocabulary.size, vocabulary.tails, vocabulary.together, vocabulary.beside, vocabulary.stands
    last = [-1]  # of each prefix on the path: its last token
    path = ""  # the symbols that lead to the present node
    for word in sorted(words):
        shared, most = 0, min(len(path), len(word) - 1)
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del last[shared + 1 :]
        path = word[:-1]
        for n in range(shared + 1, len(word) + 1):
            end = suffix if n == len(word) else ""
            for k in tails.get(word[max(n - 3, 0) : n] + end, (2, 1)):
                if k > n:
                    continue
                token = ids.get(word[n - k : n] + end)
                if token is None:
                    continue
                if n > k:
                    good = together.get(last[n - k] * size + token)
                    if good is None:
                        good = beside(last[n - k], token)
                else:
                    good = stands(token)
                if good:
                    last.append(token)
                    break
        found, n = [], len(word)
        while n:
            found.append(last[n])
            n -= lengths[last[n]]
        last.pop()  # the end isn't on the path of longer words
        yield word, found[::-1]


class TrieEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        made = json.loads(library.to_str())
        self.vocabulary = Vocabulary(made["model"])
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        added = made.get("added_tokens", [])
        if made.get("post_processor") or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("only special tokens that stand for their very string are supported")
        if not self.splitter or "ByteLevel" not in json.dumps(made["pre_tokenizer"]):
            raise ValueError("only tokenizers that split into byte characters are supported")
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        # texts of Latin letters are split here, with the tokenizer's own pattern
        self.latin = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])] == NORMALIZERS and bool(steps) and steps[0].get("pattern") == {"Regex": SPLIT}
        self.special = {x["content"]: x["id"] for x in added}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        shown = byte_characters()
        self.to_bytes = {ord(c): b for b, c in shown.items()}
        self.to_characters = [shown[b] for b in range(256)]
        self.names = [""] * max(self.vocabulary.size, 1 + max(self.special.values(), default=0))
        for x, i in (self.vocabulary.ids | self.special).items():
            self.names[i] = x
        self.numbers = list(map(str, range(len(self.names))))
        decoder = made.get("decoder")
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError("only byte-level decoders, or none, are supported")
        self.bytes_of = [self._raw(x) for x in self.names] if decoder else None
        self.forget()

    def _raw(self, characters: str) -> bytes:
        if all(ord(c) in self.to_bytes for c in characters):
            return bytes(self.to_bytes[ord(c)] for c in characters)
        return characters.encode()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.said: list[str] = []
        self.read: list[str] = []

    def split(self, text: str) -> list[str]:
        """A text's words; a special token is its string after a line end, as no word is."""
        if self.latin and not any(x in text for x in self.special) and (text.isascii() or not ODD.search(text)):
            return PIECE.findall(text.lower())
        out = []
        for k, part in enumerate(self.special_pattern.split(text) if self.special_pattern else [text]):
            if k % 2:
                out.append("\n" + part)
            elif part:
                normal = self.normalizer.normalize_str(part) if self.normalizer else part
                out += [bytes(self.to_bytes[ord(c)] for c in x).decode() for x, _ in self.splitter.pre_tokenize_str(normal)]
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.bytes_of is None:
            return " ".join(map(self.names.__getitem__, ids))
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def places(self, texts: list[str]) -> list[list[int]]:
        """For each text the places of its words in ids, said (decimal) and read (decoded)."""
        split = list(map(self.split, texts))
        seen = set().union(*split)
        new = seen.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.forget()
            new = seen
        to = self.to_characters
        shown = {"".join(map(to.__getitem__, x.encode())): x for x in new if x[0] != "\n" or x[1:] not in self.special}
        for word, ids in encode_words(self.vocabulary, list(shown)):
            self._keep(shown[word], ids)
        for x in new.difference(self.known):
            self._keep(x, [self.special[x[1:]]])
        get = self.known.__getitem__
        return [list(map(get, x)) for x in split]

    def _keep(self, word: str, ids: list[int]) -> None:
        self.known[word] = len(self.ids)
        self.ids.append(array("i", ids).tobytes())
        self.said.append(" ".join(map(self.numbers.__getitem__, ids)))
        self.read.append(self.decode(ids))

    def joined(self, read: list[str]) -> str:
        return (" " if self.bytes_of is None else "").join(read)


@lru_cache(maxsize=2)
def _made(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def trie_encoder(path: str) -> TrieEncoder:
    """One per worker process and tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    claim("bpe_trie", _made.cache_clear)
    return _made(path)


def encode_texts(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of every row."""
    path = tokenizer_path or default_path()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = trie_encoder(path)
        for part in parts:
            texts = part.column(1).to_pylist()
            for i, j in batches(texts, BATCH_BYTES):
                ids = [np.frombuffer(b"".join(map(encode.ids.__getitem__, places)), np.int32) for places in encode.places(texts[i:j])]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return arrow(df.select(F.col(id_column).cast("long").alias("_id"), text_of(text_column).alias("_text")), run, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, *, id_column: str = "doc_id", ids_column: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, text: what each row's ids decode to, special tokens included; null ids: empty.  An id outside the vocabulary raises."""
    path = tokenizer_path or default_path()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = trie_encoder(path)
        for part in parts:
            texts = [encode.decode(x or []) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow(df.select(F.col(id_column).cast("long").alias("_id"), F.col(ids_column).cast("array<int>").alias("_ids")), run, "doc_id long, text string")


def bpe_digest(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 of every row: encoded, and decoded from the ids."""
    path = tokenizer_path or default_path()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = trie_encoder(path)
        for part in parts:
            texts, counts, said, read = part.column(1).to_pylist(), [], [], []
            for i, j in batches(texts, BATCH_BYTES):
                for places in encode.places(texts[i:j]):
                    numbers = " ".join(map(encode.said.__getitem__, places))
                    counts.append(numbers.count(" ") + 1 if numbers else 0)
                    said.append(hashlib.sha256(numbers.encode()).hexdigest())
                    # words are whole characters, so what they decode to is decoded by itself
                    read.append(hashlib.sha256(encode.joined(map(encode.read.__getitem__, places)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(said, pa.string()), pa.array(read, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow(df.select(F.col(id_column).cast("long").alias("_id"), text_of(text_column).alias("_text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
