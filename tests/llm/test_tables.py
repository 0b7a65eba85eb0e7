"""Registered queries on the driver's tables and on awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.oracle import ROOT, difference
from textmill.llm import catalog, html_text
from textmill.llm.bytenet import Settings as Net
from textmill.llm.bytenet import quality_scores
from textmill.llm.divergence import quality_rules
from textmill.llm.forest import near_components, without_near_duplicates
from textmill.llm.language import language_id
from textmill.llm.mixing import mix
from textmill.llm.packing import pack_documents
from textmill.llm.passages import passage_digest
from textmill.llm.projections import near_vectors
from textmill.llm.token_files import token_digest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    assert difference(spark, catalog.queries()[name], catalog.oracle_sql()[name], f"{ROOT}/sf0.01") == ""


def test_near_texts_by_search(spark):
    """Every text whose id is divisible by 50 against all: each link is within a component."""
    rows = spark.read.parquet(f"{ROOT}/sf0.1/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["component_id"] for r in catalog.queries()["op10_lsh_forest"](spark, f"{ROOT}/sf0.1").collect()}
    sets, where = {}, {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        n = min(3, len(w))
        sets[i] = {hash(tuple(w[k : k + n])) for k in range(len(w) - n + 1)} if w else set()
        for x in sets[i]:
            where.setdefault(x, []).append(i)
    found = 0
    for i in sets:
        if i % 50 == 0:
            for j, common in Counter(j for x in sets[i] for j in where[x]).items():
                if j != i and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    found += 1
                    assert got[i] == got[j], (i, j)
    assert found > 20


def test_near_vectors_by_search(spark):
    rows = spark.read.parquet(f"{ROOT}/sf0.1/embeddings.parquet").collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in catalog.queries()["op9_sorted_projections"](spark, f"{ROOT}/sf0.1").collect()}
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, labels = [r["vec_id"] for r in rows], np.array([r["label"] for r in rows])
    for k, i in enumerate(ids):
        if i % 50 == 0:
            near = np.flatnonzero((x @ x[k] >= 0.93) & (labels == labels[k]) & (np.arange(len(ids)) != k))
            assert got[i][0] == len(near)
            assert all(got[ids[j]][1] == got[i][1] for j in near)


def test_planted_vectors_of_a_large_label(spark):
    """Pairs just over the threshold, a third of the label in one dense place, many windows and passes."""
    r, n, d = np.random.default_rng(4), 24_000, 32
    x = r.normal(size=(n, d))
    x[: n // 3] = x[0] / np.linalg.norm(x[0]) + 0.5 * x[: n // 3] / np.linalg.norm(x[: n // 3], axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(300):
        v = r.normal(size=d)
        v -= (v @ x[2 * i]) * x[2 * i]
        x[2 * i + 1] = 0.935 * x[2 * i] + np.sqrt(1 - 0.935**2) * v / np.linalg.norm(v)
    frame = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {k["vec_id"]: (k["n_links"], k["component_id"]) for k in near_vectors(frame).collect()}
    for begin in range(0, n, 4000):
        near = x[begin : begin + 4000] @ x.T >= 0.93
        for i in range(len(near)):
            others = np.flatnonzero(near[i])
            assert got[begin + i][0] == len(others) - 1
            assert {got[int(j)][1] for j in others} == {got[begin + i][1]}


def test_very_long_texts(spark):
    r = random.Random(1)
    long_ = " ".join(f"word{r.randrange(10**6)}" for _ in range(130_000))
    rows = [(1, long_, "en", "a"), (2, long_[:-30], "en", "b"), (3, "a short text of the other kind", "en", "a"), (4, "x" * 1_300_000, "en", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    by = lambda df: {x["doc_id"]: x for x in df.collect()}
    near = by(near_components(d))
    assert near[2]["component_id"] == 1 and near[4]["component_id"] == 4 and near[1]["n_shingles"] == len({tuple(x) for x in zip(*(long_.split()[k:] for k in range(3)), strict=False)})
    cut = by(passage_digest(d))
    assert cut[2]["n_removed"] == len(long_) - 30 and cut[4]["n_removed"] == 1_300_000 - 1 and cut[1]["n_removed"] == 0
    rules = by(quality_rules(d))
    assert [rules[i]["n_words"] for i in (1, 2, 4)] == [130_000, len(long_[:-30].split()), 1]
    files, pieces = by(token_digest(d)), Counter()
    for p in pack_documents(d).collect():
        pieces[p["doc_id"]] += p["length"]
    assert pieces == {i: x["n_tokens"] for i, x in files.items()} and pieces[1] > 130_000
    assert by(language_id(d))[1]["lang_pred"] == "en" and by(mix(d))[1]["size"] == 130_000
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= x["score"] <= 1 for x in quality_scores(d, labels, settings=Net(filters=4, epochs=1)).collect())
    pages = spark.createDataFrame([(1, "u", f"<article><h1>T</h1><p>{long_}</p></article>")], "page_id long, url string, html string")
    assert html_text.html_main_text(pages).first()["n_chars"] == len(long_) + 2


def test_texts_without_ids(spark):
    """Texts of one id, or of none, are told apart, whatever their hashes are."""
    r = random.Random(3)
    make = lambda n: " ".join(f"{r.randrange(10**8):08d}" for _ in range(n))
    a, b, c = make(40), make(40), make(44)
    rows = [(None, a), (None, b), (1, a[:110]), (None, b), (7, c), (7, c[:150] + make(5)), (None, None), (None, "")]
    got = [(x["n_bytes"], x["n_removed"]) for x in passage_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(got)[(len(a), 110)] == 1 and Counter(got)[(len(b), 0)] == 2 and Counter(got)[(0, 0)] == 2 and Counter(got)[(110, 0)] == 1
    seven = sorted(x for x in got if x[0] in (len(c), 150 + 44))
    assert len(got) == len(rows) and any(n for _, n in seven)


def test_one_row_of_each_group_stays(spark):
    r = random.Random(5)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base = make(200)
    near = [*base[:100], "other", *base[101:]]
    far = " ".join(make(60))
    rows = [(None, " ".join(base), 1), (5, " ".join(near), 2), (3, " ".join(base), 3), (3, " ".join(base), 4), (3, far, 5), (None, far, 6), (8, "...", 7), (None, None, 8), (None, None, 9), (9, "", 10), (None, " ".join(make(60)), 11)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key int")
    out = without_near_duplicates(d)
    kept = sorted(x["key"] for x in out.collect())
    assert out.columns == d.columns
    # one of base's (the smallest id, either of two equal rows), one of far's, all without partners or words
    assert kept[1:] == [5, 7, 8, 9, 10, 11] and kept[0] in (3, 4)


@pytest.mark.parametrize("table", ["labels", "embeddings", "pages"])
def test_clashing_columns(spark, table):
    if table == "labels":
        docs = spark.createDataFrame([(i, f"text {i} " * 9, "en", 1, 1, 1, 1) for i in range(40)], "doc_id long, text string, lang string, quality int, toxic int, _u int, count int")
        labels = spark.createDataFrame([(i, i % 2, 0, "x", 3, 4, 5) for i in range(40)], "doc_id long, quality int, toxic int, text string, _label int, _h int, held_out int")
        assert quality_scores(docs, labels, settings=Net(filters=3, epochs=1)).columns == ["doc_id", "held_out", "score", "predicted"]
    elif table == "embeddings":
        names = "id digest weight vertex place bits code h pass own other unit left same blocks n n_links component kept".split()
        rows = [(i, [1.0, float(i % 2), 0.5], 1, *range(len(names))) for i in range(6)]
        got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, " + ", ".join(f"`{n}` int" for n in names))).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (2, i % 2) for i in range(6)}
    else:
        rows = [(1, "u", "<p>text</p>", 5, 6, 7)]
        got = html_text.html_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int, n_chars int, `value` int")).collect()
        assert [tuple(x) for x in got] == [(1, "u", "text", 4)]
