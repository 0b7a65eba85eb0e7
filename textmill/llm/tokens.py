"""Encoding with a tokenizer file of the `tokenizers` library, at the speed of a dictionary.

A tokenizer that lower-cases, splits with a fixed pattern and encodes each piece by itself gives
every distinct piece the same ids wherever it stands.  For such a tokenizer `Encoder` splits texts
itself, lets the library encode each new piece once, and joins the ids it has seen.  Texts with any
character for which this has not been established, and all texts under other tokenizers, go through
the library whole; the result is the same either way (tests compare the two).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np

from textmill.llm.common import claim

#: The pipeline of the tokenizer kind that can be split into independent pieces.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

#: Pieces in each of the two generations of a worker's cache (memory only, never results).
CACHE_PIECES = 600_000
#: New pieces that the library encodes as one text.
AT_ONCE = 2000
#: Characters below this code point are split here; it covers the Latin blocks.
LATIN_END = 0x250


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c)).startswith(kind))


def _changes_block(c: int) -> bool:
    low = chr(c).lower()
    return len(low) > 1 or ord(low) >= LATIN_END or unicodedata.normalize("NFC", chr(c)) != chr(c)


_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_SPACE}{_class('L')}{_class('N')}]+")
ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in range(LATIN_END) if _changes_block(c)) + f"\\u{LATIN_END:04x}-\U0010ffff]")


class Encoder:
    def __init__(self, path: str, end_id: int | None, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.library, self.cache_pieces = Tokenizer.from_file(path), cache_pieces
        self.end = b"" if end_id is None else np.uint32(end_id).tobytes()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        made = json.loads(self.library.to_str())
        normal, pre = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [])
        self.by_piece = (
            [x["type"] for x in normal.get("normalizers", [])] == NORMALIZERS
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": SPLIT}
            and steps[0]["invert"]
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
            and not made.get("post_processor")
        )
        suffix = made["model"].get("end_of_word_suffix")
        if self.by_piece and suffix:
            # the same model over pieces that are normal and split already, with white space between
            own = made | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
            self.pieces = Tokenizer.from_str(json.dumps(own))
            vocabulary = made["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self.by_piece = bool(self.by_piece and suffix)
        self.never = [x["content"] for x in made.get("added_tokens", [])]

    def _splits(self, x: str) -> bool:
        """Whether x is split here."""
        return self.by_piece and not any(s in x for s in self.never) and (x.isascii() or not ODD.search(x))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces not seen before; where each one's ids end shows in the suffix of its last token."""
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            ids = np.asarray(self.pieces.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, stops = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.known.update(zip(some, (raw[x:y] for x, y in pairwise(stops)), strict=True))
            else:
                self.known.update(zip(some, self._whole(some), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, the end id included, as little-endian unsigned 32-bit integers."""
        split = [PIECE.findall(x.lower()) if self._splits(x) else None for x in texts]
        seen = set().union(*(s for s in split if s))
        if len(self.known) + len(seen) > self.cache_pieces:
            self.older, self.known = self.known, {}
        seen.difference_update(self.known)
        again = seen.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self._learn(list(seen - again))
        get, rest = self.known.__getitem__, iter(self._whole([x for x, s in zip(texts, split, strict=True) if s is None]))
        return [(next(rest) if s is None else b"".join(map(get, s))) + self.end for s in split]


@lru_cache(maxsize=4)
def _made(path: str, end_id: int | None, cache_pieces: int) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, end_id, cache_pieces)


def encoder(path: str, end_id: int | None = None, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """One per worker process and tokenizer."""
    claim("tokens", _made.cache_clear)
    return _made(path, end_id, cache_pieces)


def batches(texts, most_bytes: int = 4 << 20):
    """Runs of consecutive (index range) texts of about most_bytes, so that memory is bounded by one long text."""
    begin = held = 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= most_bytes:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
