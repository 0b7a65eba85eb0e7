from __future__ import annotations

import random
import re

import numpy as np
import pytest

from textmill.llm import forest
from textmill.llm.components import connected_components
from textmill.llm.projections import Settings as Vectors
from textmill.llm.projections import _spanning, near_vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def union(pairs, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty", "shuffled path"])
def test_components(spark, shape):
    r = random.Random(2)
    names = list(range(300))
    if shape == "shuffled path":
        r.shuffle(names)
    pairs = {"path": [(i, i + 1) for i in range(250)], "shuffled path": list(zip(names, names[1:], strict=False)), "star": [(299, i) for i in range(200)], "random": [(r.randrange(300), r.randrange(300)) for _ in range(200)], "empty": []}[shape]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(pairs, range(300))
    assert got == {i: want[i] for p in pairs for i in p}


def test_hashes_are_of_words():
    raw = "The cat  SAT\non é mat\tThe".encode()
    h = forest.word_hashes(np.frombuffer(raw, np.uint8))
    assert len(h) == 7 and h[0] == h[6] and len(set(h.tolist())) == 6
    assert (forest.shingles("the CAT sat on", 3) == forest.shingles(" The cat\nsat  ON ", 3)).all()
    assert len(forest.shingles("", 3)) == 0 and len(forest.shingles("one two", 3)) == 1 and len(forest.shingles("É é", 1)) == 2


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = "some words of a long text " * 100 + "x" * 300 + " end"
    whole = forest.shingles(text, 3)
    monkeypatch.setattr(forest, "PART", 64)
    assert (forest.shingles(text, 3) == whole).all()


def brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        n = min(words, len(w))
        sets.setdefault(i, []).append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    ids = list(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[:x] for s in sets[a] for t in sets[b] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    return sets, union(pairs, ids)


SMALL = forest.Settings(region=4, together=6, shingles=900, fine_trees=24)
REGIONS = forest.Settings(region=6, together=6, most_blocks=1, fine_trees=24)


@pytest.mark.parametrize("settings", [forest.Settings(), forest.Settings(words=5, percent=80), SMALL, REGIONS])
def test_documents(documents, corpus, nothing, settings):
    got = forest.near_components(documents, settings=settings).collect()
    sets, want = brute([(i, t) for i, t, *_ in corpus if i is not None], settings.words, settings.percent)
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
    assert forest.near_components(nothing).count() == 0


def test_a_large_group(spark):
    r = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    _, want = brute(rows, 3, 85)
    for settings in (forest.Settings(), forest.Settings(region=40), forest.Settings(together=40, shingles=3000), forest.Settings(region=40, together=60, most_blocks=1)):
        got = {x["doc_id"]: x["component_id"] for x in forest.near_components(d, settings=settings).collect()}
        assert got == want, settings


def covered(rows):
    """Pairs of ids that share a region or unit."""
    by = {}
    for h, i in rows:
        by.setdefault(h, set()).add(i)
    return {(a, b) for x in by.values() for a in x for b in x if a < b}


def test_a_large_region_keeps_every_pair(spark):
    rows = [(i, [1, 2, *range(100 * i, 100 * i + 6)]) for i in range(40)]
    found, twins = forest.regions(spark.createDataFrame(rows, "id long, signature array<int>"), forest.Settings(values=8, trees=1, fine_trees=1, region=4, first_depth=1, percent=10, missed=0.99))
    assert not twins.count() and forest.Settings(values=8, fine_trees=1, first_depth=1, percent=10, missed=0.99).deepest() == 1
    found, _ = forest.regions(spark.createDataFrame([(i, [1] * 8 + [0] * (i == 0)) for i in range(40)], "id long, signature array<int>"), forest.Settings(values=8, trees=1, region=50))
    assert covered(map(tuple, found.select("h", "id").collect())) == {(a, b) for a in range(40) for b in range(a + 1, 40)}


def test_what_stays_too_large_at_the_last_depth_is_compared_in_blocks(spark):
    now = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 90), (2, 91)], "h long, id long")
    found = forest._paired(now, now.filter("h = 1").groupBy("h").count(), forest.Settings(region=7))
    assert covered(map(tuple, found.collect())) == {(a, b) for a in range(30) for b in range(a + 1, 30)}


def test_depth_follows_the_loss_that_is_allowed():
    s = forest.Settings()
    assert s.first_depth < s.deepest() < 12 and 55 < s.least() < 70
    assert forest.Settings(missed=1e-3).deepest() > s.deepest() >= forest.Settings(percent=80).deepest()


@pytest.mark.parametrize("most_blocks", [1, 64])
def test_a_large_component_keeps_every_pair(spark, most_blocks):
    sizes = {i: 1 + i * i // 3 for i in range(60)}
    found = forest._units(spark.createDataFrame([(0, i, n) for i, n in sizes.items()], "component long, id long, n long"), forest.Settings(together=4, most_blocks=most_blocks))
    pairs = covered(map(tuple, found.collect()))
    assert {(a, b) for a in sizes for b in sizes if a < b and 100 * sizes[a] >= 85 * sizes[b]} <= pairs
    assert len(pairs) < 60 * 59 / 2 if most_blocks == 1 else len(pairs) == 60 * 59 / 2


def vectors(n=300):
    r = np.random.default_rng(6)
    x = r.normal(size=(n, 16))
    for i in range(60, 160):
        x[i] = x[i % 7] + r.normal(size=16) * (0.12 if i % 3 else 0.35)
    x[200] = x[3]
    x[201] = 2 * x[4]
    return [(i, [float(v) for v in x[i]], int(i % 7 % 3)) for i in range(n)]


def brute_vectors(rows, least):
    # a vector's direction: products of very large or small components would overflow or vanish
    good = [(i, np.array(v, float) / np.abs(v).max(), l) for i, v, l in rows if i is not None and v is not None and l is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    pairs = [(a, b) for k, (a, x, l) in enumerate(good) for b, y, m in good[:k] if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least]
    links = {i: 0 for i, _, _ in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, union(pairs, [i for i, _, _ in rows if i is not None])


@pytest.mark.parametrize("settings", [Vectors(), Vectors(block=40), Vectors(block=8)])
def test_vectors(spark, settings):
    rows = vectors() + [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0, None], 1), (403, [float("nan")] * 16, 0), (404, vectors()[0][1], None), (405, [1e-200, 1e-200], 1), (406, [1e200, 1e200], 1), (407, [], 1)]
    d = spark.createDataFrame([(*x, 1, 2, "x", True) for x in rows], "vec_id long, embedding array<double>, label int, component int, vector int, place string, left boolean")
    links, want = brute_vectors(rows, 0.93)
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors(d, settings=settings).collect()}
    assert got == {i: (links[i], want[i], want[i] == i) for i in links}
    assert near_vectors(d.limit(0)).count() == 0


def test_passes_follow_the_bits():
    s = Vectors()
    assert s.passes(0) == 1 and 8 < s.passes(2) < 12 and s.passes(16) > 60


def test_spanning_links():
    r = np.random.default_rng(1)
    pairs = r.integers(0, 60, (45, 2))
    want = union([tuple(x) for x in pairs.tolist() if x[0] != x[1]], range(60))
    got = _spanning(60, pairs[pairs[:, 0] != pairs[:, 1]])
    assert union([tuple(x) for x in got.tolist()], range(60)) == want and len(got) == 60 - len(set(want.values()))


def test_repeated_vectors_and_null_ids(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, near_vectors(d).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True), (3, 0, 3, True)], key=repr)
