from __future__ import annotations

import math

import numpy as np
import pytest

from tests.oracle import ROOT
from textmill.llm.whitening import Settings, fit_list, lanczos, learn, whiten, whole

KIND = "vec_id long, embedding array<float>, label int, n long, x int, id int, at int, component int"


def brute(rows):
    """Kept rows' x, list of distinct ones, exact deviations, eigenvalues and eigenvectors of the covariance."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in kept]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    kept = [(i, x) for i, x in kept if len(x) == d]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in kept]
    mean = np.array([s / n for s in sums])
    return [i for i, _ in kept], np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for _, x in kept]), deviations, n, values[order], vectors[:, order], values.sum(), mean


def check(found, rows):
    ids, centred, deviations, n, values, vectors, trace, _ = brute(rows)
    k = int((values > 1e-12 * values[0]).sum())
    assert len(found) == len(ids) * k
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, []).append(r)
    expected = centred @ (vectors[:, :k] / np.sqrt(values[:k]))
    at = {}
    signs = np.zeros(k)
    for i, e, dev in zip(ids, expected, deviations, strict=True):
        own = sorted(by_id[i], key=lambda r: (r.component))[at.get(i, 0) :: ids.count(i)] if ids.count(i) > 1 else sorted(by_id[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, k + 1))
        assert all(r.n == n and r.deviation == dev for r in own)
        got = np.array([r.whitened for r in own])
        signs = np.where((signs == 0) & (np.abs(e) > 1e-3), np.sign(got * e), signs)
        np.testing.assert_allclose(got, np.where(signs == 0, 1, signs) * e, atol=1e-6)
        np.testing.assert_allclose([r.explained for r in own], values[:k] / trace, rtol=1e-9)
        assert {r.identity_error for r in own} == {own[0].identity_error} and own[0].identity_error < 1e-9


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    scales = 3.0 * 0.8 ** np.arange(24)
    out = [(i, [float(np.float32(c)) for c in r.normal(size=24) * scales + 0.3]) for i in range(300)]
    out += [(300 + i, out[i][1]) for i in range(150)]  # copies count once in the list
    out += [(500, None), (501, [None] * 24), (502, [math.nan, *[0.0] * 23]), (503, [math.inf, *[0.0] * 23]), (504, [1.0, 2.0]), (505, [])]
    return out


def test_against_eigenvectors_of_the_covariance(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in rows], KIND).repartition(5)
    check(whiten(df).collect(), [(i, v) for i, v in rows if v is None or len(v) == 24])


def test_entries_beyond_whole_numbers_are_dropped(spark, rows):
    more = [*rows[:40], (900, [1e300, *[0.0] * 23])]
    df = spark.createDataFrame(more, "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whiten(df).collect()} == {i for i, _ in rows[:40]}


def test_deviations_beyond_a_long_are_null(spark):
    df = spark.createDataFrame([(1, [0.0, 1e13]), (2, [1e13, 5.0]), (3, [2.0, -7e12])], "vec_id long, embedding array<double>")
    found = whiten(df).collect()
    assert len(found) == 6 and all(r.deviation is None for r in found) and all(math.isfinite(r.whitened) for r in found)


def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whiten(df.limit(0)).collect() == []
    assert whiten(df.filter("vec_id IN (0, 300)")).collect() == []  # one distinct vector: no variance
    two = whiten(df.filter("vec_id IN (0, 1, 300)")).collect()
    assert sorted((r.vec_id, r.component) for r in two) == [(0, 1), (1, 1), (300, 1)]
    assert all(abs(abs(r.whitened) - 1) < 1e-9 and abs(r.explained - 1) < 1e-9 for r in two)


@pytest.mark.parametrize("d, rank, equal", [(60, 60, 0), (60, 60, 9), (40, 5, 0), (12, 12, 12), (3, 3, 0)])
def test_lanczos_finds_leading_pairs(d, rank, equal):
    r = np.random.default_rng(d + rank)
    values = np.concatenate([np.sort(r.uniform(0.1, 9, rank))[::-1], np.zeros(d - rank)])
    values[:equal] = 9.5
    turn = np.linalg.qr(r.normal(size=(d, d)))[0]
    v = (turn * values) @ turn.T
    found, vectors, passes = lanczos(lambda block: v @ block, d, Settings(components=8, block=4))
    k = min(8, d)
    np.testing.assert_allclose(found, values[:k], atol=1e-12)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    np.testing.assert_allclose(v @ vectors, vectors * found, atol=1e-11)
    assert passes <= d


def test_stops_by_residual_before_the_space_is_spanned():
    v = np.diag(np.concatenate([[1000.0, 500, 200], np.full(297, 1e-3) * np.linspace(1, 1.0001, 297)]))
    _, _, passes = lanczos(lambda block: v @ block, 300, Settings(components=3, block=4))
    assert passes < 12


def test_all_given_vectors(spark):
    df = spark.read.parquet(f"{ROOT}/sf0.01/embeddings.parquet")
    check(whiten(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])
    s = Settings()
    fit = fit_list(df.select(whole(df["embedding"].cast("array<double>"), s).alias("x")).filter("x IS NOT NULL"))
    assert learn(fit, s).passes <= 64 // s.block
