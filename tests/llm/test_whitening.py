"""Whitening against a direct eigen-decomposition of the covariance."""

import os
from fractions import Fraction

import numpy as np
import pytest

from mailframe.llm import whitening

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SCHEMA = "vec_id long, embedding array<double>, x string, n long"


def check(spark, rows, components=whitening.COMPONENTS):
    """Whiten rows of (id, vector) and compare every column with a direct computation."""
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found = whitening.whiten(whitening.shifted_vectors(table), components).collect()
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + whitening.OFFSET for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(found) == kept * len(good)
    deviations = sorted(((i, int(sum(int(d) ** 2 for d in n * row - sums))) for (i, _), row in zip(good, x, strict=True)), key=str)
    for c in range(1, kept + 1):
        rows_c = [r for r in found if r.component == c]
        assert sorted(((r.vec_id, r.deviation) for r in rows_c), key=str) == deviations
        assert {r.n for r in rows_c} == {n}
        assert rows_c[0].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    assert found[0].identity_error < 1e-8
    ids = [i for i, _ in good]
    if len(set(ids)) == len(ids):
        place = {i: at for at, i in enumerate(ids)}
        got = np.empty((len(ids), kept))
        for r in found:
            got[place[r.vec_id], r.component - 1] = r.whitened
        want = ((n * x - sums) / n) @ vectors[:, :kept] / np.sqrt(values[:kept])
        gaps = np.abs(np.diff(values))[:kept]
        if (gaps > 1e-6 * values[0]).all():
            want *= np.sign((got * want).sum(axis=0))
            assert np.abs(got - want).max() < 1e-6 * max(1, np.abs(want).max())
    return found


def test_whitening_equals_direct_decomposition(spark):
    rng = np.random.default_rng(1)
    shape = rng.normal(size=(20, 20)) * np.linspace(0.1, 3, 20)
    vectors = rng.normal(size=(400, 20)) @ shape
    check(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])


def test_copies_count_once_and_unusable_vectors_go(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 5)) * [1, 2, 3, 4, 5])]
    hot = rows[7][1]
    rows += [(100 + i, hot) for i in range(50)] + [(None, hot), (7, hot)]
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5)]
    check(spark, rows, 3)


def test_vectors_in_a_plane_have_fewer_components(spark):
    rows = [(i, [float(i), float(i * i % 7), 2.0 * i, 5.0]) for i in range(30)]
    found = check(spark, rows)
    assert max(r.component for r in found) == 2


def test_badly_conditioned_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 6)) * [1e7, 1e5, 1e3, 10, 1, 1]
    vectors[:, 5] += vectors[:, 0]
    found = whitening.whiten(whitening.shifted_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")))
    assert found.where("component = 6").count() == 300
    assert found.first().identity_error < 1e-4


def test_the_orthogonal_rows_of_the_last_pass_are_orthonormal(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(200, 4)) * [1, 10, 100, 1000]).astype(int)
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    sums = whitening.fit_sums(fit, 4)
    assert sums == x.sum(axis=0).tolist()
    r = whitening.triangular_factor(fit, 200, sums)
    centred = x - x.mean(axis=0)
    assert np.allclose(np.tril(r, -1), 0)
    q = whitening.solve_right(centred, [r])
    assert np.abs(q.T @ q - np.eye(4)).max() < 1e-12


def test_large_entries_are_exact_or_null(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitening.whiten(whitening.shifted_vectors(table)).collect()
    assert {r.deviation for r in found if r.vec_id in (1, 2)} == {None}
    assert all(np.isfinite(r.whitened) for r in found)
    big = [(i, [float(2**30 * i)]) for i in range(3)]
    found = whitening.whiten(whitening.shifted_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>"))).collect()
    centre = Fraction(64 * 2**30)
    assert {(r.vec_id, r.deviation) for r in found if r.vec_id == 1} == {(1, 0)}
    assert {r.deviation for r in found if r.vec_id != 1} == {None if (3 * centre) ** 2 >= 2**63 else int((3 * centre) ** 2)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_nothing_to_whiten_gives_no_rows(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(whitening.shifted_vectors(table)).collect() == []


def test_short_vectors_go_on_in_zeros(spark):
    rows = [(1, [1.0]), (2, [1.0, 0.0]), (3, [4.0, 2.0]), (4, [0.0, 7.0])]
    found = whitening.whiten(whitening.shifted_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    assert {r.n for r in found} == {3}
    assert {r.whitened for r in found if r.vec_id == 1} == {r.whitened for r in found if r.vec_id == 2}


@needs_data
def test_given_vectors(spark):
    embeddings = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(spark, [(r.vec_id, [float(c) for c in r.embedding]) for r in embeddings.collect()])
