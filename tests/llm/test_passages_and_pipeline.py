from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textmill.llm import passages
from textmill.llm.passages import Settings, anchors, columns, passage_digest, without_repeats
from textmill.llm.tokens import default_path, encoder


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, digest, kept) for texts in order."""
    seen, out = set(), []
    for text in texts:
        b = (text or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                mark[i] += 1
                mark[i + length] -= 1
            seen.add(b[i : i + length])
        gone = np.cumsum(mark[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("part", [1 << 20, 300])
def test_every_window_has_its_anchor(monkeypatch, part):
    monkeypatch.setattr(passages, "PART", part)
    r = np.random.default_rng(3)
    s = Settings(length=40, gram=12)
    data = np.concatenate([r.integers(97, 123, 900), np.full(200, 97), np.tile([97, 98, 99], 60), r.integers(97, 100, 500)]).astype(np.uint8)
    at, _ = anchors(data, s)
    held = np.zeros(len(data), bool)
    held[at] = True
    for i in range(len(data) - 39):
        assert held[i : i + 29].any()
    again, _ = anchors(data[37:], s)
    inner = {x for x in at.tolist() if x >= 37 + 28}
    assert inner <= {x + 37 for x in again.tolist()}


@pytest.mark.parametrize("symbols", [2, 4, 200])
def test_columns(tmp_path, symbols):
    r = np.random.default_rng(symbols)
    n, m, length = 60, 30, 8
    x = r.integers(0, symbols, (n, m)).astype(np.uint16)
    x[20:50] = x[r.integers(0, 20, 30)]
    for i in range(20, 50):
        x[i, r.integers(0, m)] = 999
    rank, low, high = r.permutation(n), r.integers(0, 4, n), r.integers(m - 4, m + 1, n)
    got = columns(np.ascontiguousarray(x.T), rank, low, high, length, f"file://{tmp_path}/block").T
    assert not list(tmp_path.iterdir())
    for j in range(m - length + 1):
        for i in range(n):
            earlier = any(rank[k] < rank[i] and (x[k, j : j + length] == x[i, j : j + length]).all() for k in range(n))
            assert got[i, j] == (earlier and low[i] <= j and j + length <= high[i])


@pytest.mark.parametrize("settings", [Settings(), Settings(length=40, gram=12, block=16), Settings(length=30, gram=10, block=4, most_contexts=3)])
def test_documents(spark, documents, corpus, nothing, settings):
    rows = {(i, t) for i, t, *_ in corpus}
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    got = {r["doc_id"]: tuple(r)[1:] for r in passage_digest(documents, settings=settings).collect()}
    want = brute([t for _, t in order], settings.length)
    for (i, _), w in zip(order, want, strict=True):
        assert got[i] == w[:4], i
    assert passage_digest(documents, settings=settings).count() == len(corpus)
    assert passage_digest(nothing).count() == 0
    cut = without_repeats(documents, settings=settings)
    assert cut.columns == documents.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    for (i, t), w in zip(order, want, strict=True):
        assert texts[i] == (t if not w[1] else w[4].decode("utf-8", "ignore"))


def test_few_symbols(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 400))) for _ in range(60)] + ["é" * 90, "xé" * 60, "éx" * 60]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = Settings(length=14, gram=5, block=50, most_contexts=20)
    got = {x["doc_id"]: tuple(x)[1:] for x in passage_digest(d, settings=s).collect()}
    assert [got[i] for i in range(len(texts))] == [w[:4] for w in brute(texts, 14)]


def test_pipeline_stages(spark, documents, corpus, nothing):
    spec = documents.withColumns({"_lang_pred": F.lit(7), "_row": F.lit(8), "_doc": F.lit(9), "_times": F.lit(3)})
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "passages", "mixture", "packing"]
    told = stages["language"](spark, spec, "")
    kept = Counter((r["doc_id"], r["text"]) for r in told.collect())
    want = Counter((i, t) for i, t, *_ in corpus if t and any(c.isalpha() for c in t))
    assert kept <= want and not any(i in dict(want - kept) for i in range(200))
    near = stages["near_duplicates"](spark, told, "").collect()
    ids = [r["doc_id"] for r in near if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and -7 in ids and 6 not in ids and set(range(7, 20)) <= set(ids)
    near = spark.createDataFrame(near, spec.schema)
    cut = stages["passages"](spark, near, "")
    rows = cut.collect()
    assert all(r["text"] and r["n_chars"] == len(r["text"]) for r in rows)
    order = sorted(near.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    whole = {r["doc_id"]: w[4].decode("utf-8", "ignore") for r, w in zip(order, brute([r["text"] for r in order], 100), strict=True)}
    assert {r["doc_id"]: r["text"] for r in rows} == {i: t for i, t in whole.items() if t}
    mixed = stages["mixture"](spark, cut, "")
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 3
    pieces = stages["packing"](spark, mixed, "").collect()
    encode = encoder(default_path(), 2).encode
    tokens = {r["doc_id"]: len(encode([r["text"]])[0]) // 4 for r in rows}
    total = Counter()
    for p in pieces:
        total[p["doc_id"]] += p["length"]
    assert total == Counter({i: n * tokens[i] for i, n in times.items()})
    extra = [c for c in spec.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for step in (told, cut, mixed):
        assert step.columns == spec.columns and step.select(*extra).distinct().count() == 1 == step.select(*extra).intersect(spec.select(*extra)).count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spec.limit(0), "")
        assert out.columns == spec.columns and out.count() == 0, name
