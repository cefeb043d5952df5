"""Whitening against exact integer sums and numpy's symmetric eigenvalues."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm import whitening
from casebook.llm.bidiagonal import bidiagonalise, right_vectors, squared_singular_values
from casebook.llm.common import table


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, "extra", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, component int")


def plain(vectors):
    """Distinct whole vectors, their mean, and numpy's eigenvalues and vectors, largest first."""
    x = np.array(sorted({tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors}))
    centred = x - x.mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], directions[:, ::-1]


def check(spark, vectors, components=4):
    x, values, directions = plain(vectors)
    kept = [j for j in range(min(components, len(values))) if values[j] > 1e-9 * values.sum()]
    got = whitening.whitened(frame(spark, vectors), components).collect()
    assert len(got) == len(vectors) * len(kept)
    n, sums = len(x), x.sum(axis=0)
    signs = {}
    for row in sorted(got, key=lambda r: (r.component, r.vec_id)):
        own = np.array([math.floor(256 * float(np.float32(c))) for c in vectors[row.vec_id]])
        assert row.n == n
        assert row.deviation == sum(int(n * a - s) ** 2 for a, s in zip(own.tolist(), sums.tolist()))
        j = row.component - 1
        want = float((own - sums / n) @ directions[:, j]) / math.sqrt(values[j])
        if abs(want) > 0.1:
            signs.setdefault(j, math.copysign(1, want * row.whitened))
        assert abs(abs(row.whitened) - abs(want)) < 1e-6 * max(1, abs(want))
        if abs(want) > 0.1:
            assert math.copysign(1, want * row.whitened) == signs[j]
        assert abs(row.explained - values[j] / values.sum()) < 1e-9
        assert row.identity_error < 1e-8
    return got


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(2, 0.2, 12) + 50).tolist()
    check(spark, vectors + vectors[:40])


def test_more_vectors_than_one_join_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 64)
    rng = np.random.default_rng(2)
    check(spark, (rng.normal(size=(500, 6)) * np.arange(1, 7)).tolist())


def test_shared_table(spark):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings").filter("embedding IS NOT NULL").collect()
    check(spark, [r.embedding for r in rows])


def test_few_dimensions_and_equal_vectors(spark):
    rng = np.random.default_rng(3)
    check(spark, rng.normal(size=(20, 2)).tolist())
    line = [[float(i), 2.0 * i, 0.0] for i in range(9)]
    check(spark, line)
    assert whitening.whitened(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whitened(frame(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whitened(frame(spark, [])).columns == [c.split()[0] for c in whitening.OUTPUT.split(", ")]


def test_unusable_vectors_and_null_ids(spark):
    good = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.5], [0.25, -1.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    got = whitening.whitened(frame(spark, good + bad, [0, 1, None, 3, 4, 5, 6, 7, 8, 9]))
    assert sorted(r.vec_id if r.vec_id is not None else -1 for r in got.filter("component = 1").collect()) == [-1, 0, 1, 3]
    assert got.agg(F.max("n")).first()[0] == 4


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(2, (0, 1), np.eye(2), np.ones(2), np.ones(2))
    assert model.deviation(np.array([[2**40, 0], [3, 1]])) == [None, 36 + 1]


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_solver_small_values_and_ties(d):
    rng = np.random.default_rng(d)
    for rows in (rng.normal(size=(3 * d, d)), rng.normal(size=(3 * d, d)) * np.logspace(0, -9, d), 3 * np.linalg.qr(rng.normal(size=(3 * d, d)))[0]):
        a, b, w = bidiagonalise(np.linalg.qr(rows, mode="r"))
        squares = squared_singular_values(a, b)
        want = np.linalg.svd(rows, compute_uv=False) ** 2
        assert np.allclose(squares, want, rtol=1e-6, atol=1e-13 * want[0])
        v = w @ right_vectors(a, b, squares[:4])
        assert np.abs(rows.T @ (rows @ v) - v * squares[:4]).max() < 1e-13 * want[0]
        assert np.abs(v.T @ v - np.eye(min(4, d))).max() < 1e-10
