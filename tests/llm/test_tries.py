from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill.llm.bpe_trie import Vocabulary, bpe_digest, decode_ids, encode_texts, encode_words
from textmill.llm.tokens import default_path

ODD_TEXTS = ["", "\n", "a" * 30_000, "aab" * 9_000, "<|endoftext|>x<|startoftext|><|endoftext|>", " <|endoftext|> A", "don't I'LL 've", "Å" * 300 + "İstanbul", "日本語 𝒳𝒴 ß À", "x\x00y▁z", None]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def expected(path, text):
    found = library(path)
    ids = found.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(found.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_digest_is_the_librarys(spark, documents):
    rows = [(i, x) for i, x in enumerate(ODD_TEXTS)]
    mixed = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [(x.doc_id, x.text) for x in mixed.collect()]
    found = sorted((tuple(x) for x in bpe_digest(mixed).collect()), key=repr)
    assert found == sorted(((i, *expected(default_path(), x)) for i, x in texts), key=repr)


def test_other_tokenizer_goes_both_ways(spark):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    ids = encode_texts(df, tokenizer_path=path)
    own = library(path)
    assert {x.doc_id: x.ids for x in ids.collect()} == {i: own.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(ODD_TEXTS)}
    assert {x.doc_id: x.text for x in decode_ids(ids, tokenizer_path=path).collect()} == {i: x or "" for i, x in enumerate(ODD_TEXTS)}


def merged(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """Merges pair by pair, as the definition says: the lowest rank first, of equal ones the leftmost."""
    made = {(left, right): (at, token) for token, (at, left, right) in vocabulary.parts.items()}
    while True:
        best = min(((made[pair][0], i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in made), default=None)
        if best is None:
            return symbols
        i = best[1]
        symbols = [*symbols[:i], made[symbols[i], symbols[i + 1]][1], *symbols[i + 2 :]]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=12, unique=True))
def test_words_are_merged_as_defined(seed, words):
    r = random.Random(seed)
    from textmill.llm.bpe_trie import byte_characters

    letters = list(byte_characters().values())
    vocabulary = {x: i for i, x in enumerate([*letters, *(x + "$" for x in letters)])}
    merges, parts = [], ["a", "b", "c", "a$", "b$", "c$"]
    for _ in range(25):
        left, right = r.choice([x for x in parts if not x.endswith("$")]), r.choice(parts)
        if left + right not in vocabulary:
            vocabulary[left + right] = len(vocabulary)
            merges.append([left, right])
            parts.append(left + right)
    own = Vocabulary({"type": "BPE", "vocab": vocabulary, "merges": merges, "end_of_word_suffix": "$"})
    found = dict(encode_words(own, words))
    for word in words:
        assert found[word] == merged(own, [vocabulary[x] for x in [*word[:-1], word[-1] + "$"]])


def test_vocabularies_that_break_the_rule_are_refused():
    from textmill.llm.bpe_trie import byte_characters

    letters = list(byte_characters().values())
    vocabulary = {x: i for i, x in enumerate([*letters, "ab", "bc", "abc"])}
    with pytest.raises(ValueError, match="two merges"):
        Vocabulary({"type": "BPE", "vocab": vocabulary, "merges": [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]]})


def test_empty_table(nothing):
    assert bpe_digest(nothing).collect() == []
    assert encode_texts(nothing).collect() == []
