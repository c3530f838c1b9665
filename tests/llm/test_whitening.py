"""Whitening against numpy's eigensolver and exact integers; the eigensolver against hard matrices."""

import numpy as np
import pytest

from clickpath.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, x string, component int, n int"


def _brute(rows):
    kept = [(i, [int(np.floor(64 * c)) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, sums = len(fit), [sum(int(x[k]) for x in fit) for k in range(len(fit[0]))]
    mean = np.array([s / n for s in sums])
    centred = fit - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, mean, values[::-1], vectors[:, ::-1]


def _check(rows, got, components=16):
    kept, n, sums, mean, values, vectors = _brute(rows)
    k = min(components, len(mean))
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(kept) * k and {r["n"] for r in got} == {n}
    w = np.array([[by_id[i][c + 1]["whitened"] for c in range(k)] for i, _ in kept])
    x = np.array([x for _, x in kept])
    for (i, v), row in zip(kept, w):
        assert {r["deviation"] for r in by_id[i].values()} == {sum((n * a - s) ** 2 for a, s in zip(v, sums))}
    want = (x - mean) @ vectors[:, :k] / np.sqrt(values[:k])
    sign = np.sign((w * want).sum(0))
    assert np.allclose(w, want * sign, atol=1e-7)
    assert np.allclose([by_id[kept[0][0]][c + 1]["explained"] for c in range(k)], values[:k] / values.sum(), rtol=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-8


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    _check(rows, queries.op13_embedding_whitening(spark, "/root/testdata/sf0.01").collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.standard_normal(5) * [1, 2, 3, 4, 5]).tolist()) for k in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [])]
    rows += [(200 + k, rows[0][1]) for k in range(30)]  # a third of the sound rows are one vector
    _check(rows, whitening.whiten(spark.createDataFrame([(*r, "z", 1, 2) for r in rows], SCHEMA).repartition(3)).collect())


def test_null_ids_repeats_and_lengths(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.25]), (3, [7.0]), (4, [9.0]), (5, [1.0, 2.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == sorted(
        [("None", 1, 3), ("None", 2, 3)] * 2 + [(str(i), c, 3) for i in (1, 2) for c in (1, 2)] + [("3", 1, 2), ("4", 1, 2)])
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    huge = [(1, [1e16, 0.0]), (2, [-1e16, 0.0]), (3, [0.0, 1.0])]
    assert {r["deviation"] for r in whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()} >= {None}


def _matrices():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    yield q @ np.diag(rng.uniform(0, 5, 40)) @ q.T
    yield q @ np.diag([3.0] * 10 + [2.0] * 10 + [1.0] * 20) @ q.T  # equal eigenvalues
    yield q @ np.diag(1 + 1e-12 * np.arange(40)) @ q.T  # one cluster
    yield q @ np.diag(10.0 ** -np.arange(40)) @ q.T
    yield np.eye(40)
    yield np.diag(np.arange(40.0))
    yield np.zeros((40, 40))
    yield np.diag([2.0] * 40) + np.diag([-1.0] * 39, 1) + np.diag([-1.0] * 39, -1)
    w = np.diag(np.abs(np.arange(41) - 20.0)) + np.diag([1.0] * 40, 1) + np.diag([1.0] * 40, -1)  # pairs agree to 14 digits
    yield w


@pytest.mark.parametrize("a", list(_matrices()))
def test_eigenpairs(a):
    a = (a + a.T) / 2
    values, vectors = whitening.leading_eigenpairs(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][:16]
    size = max(1e-300, np.abs(a).max())
    assert np.abs(values - want).max() <= 1e-13 * size * 40
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size * 40
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() <= 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(3)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-5, 5, 101)
    assert (whitening.sturm_counts(d, e, at) == [(values < x).sum() for x in at]).all()
    diag, off, _ = whitening.tridiagonal(np.diag(d) + np.outer(d, d))
    assert np.allclose(np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)), np.linalg.eigvalsh(np.diag(d) + np.outer(d, d)))
