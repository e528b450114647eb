"""Eigenvectors of sparse matrices against numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learn, spectra


def graph(spark, a):
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "id long, other long, w double")


def sparse(seed, n, parts=1):
    rng = np.random.default_rng(seed)
    a = np.zeros((n, n))
    for i in range(n):
        for j in rng.integers(0, n, 4):
            if i % parts == j % parts:
                a[i, j] = a[j, i] = rng.random()
        a[i, i] = 1
    root = 1 / np.sqrt(a.sum(1))
    return a * root[:, None] * root


@pytest.mark.parametrize("n,parts,k", [(150, 1, 3), (120, 3, 4), (9, 1, 2)])
def test_leading(spark, n, parts, k):
    a = sparse(n, n, parts)
    value, vector = np.linalg.eigh(a)
    got, rows = spectra.leading(graph(spark, a), k)
    assert np.allclose(got, value[::-1][:k], atol=1e-8)
    u = np.array([r.x for r in rows.orderBy("id").collect()])
    assert np.allclose(u.T @ u, np.eye(k), atol=1e-8) and np.abs(a @ u - u * got).max() < 1e-7
    if value[::-1][k - 1] - value[::-1][k] > 1e-2:
        angles = np.linalg.svd(vector[:, ::-1][:, :k].T @ u, compute_uv=False)
        assert np.sqrt(np.maximum(0, 1 - angles**2)).max() < 1e-6
    with pytest.raises(ValueError):
        spectra.leading(graph(spark, a[:2, :2]), 3)


def test_spectral_labels(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (30, 3)) for c in (0, 4, 9)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = [r.label for r in learn.spectral(points, 3).orderBy("id").collect()]
    assert got == [0] * 30 + [1] * 30 + [2] * 30


def test_affinity_without_itself(spark):
    """Each point has k others, also where copies have smaller ids than it."""
    from tidemark.operators import density

    x = np.concatenate([np.zeros((9, 2)), np.random.default_rng(8).standard_normal((12, 2))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    d, one = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.zeros((21, 21))
    for i in range(21):
        one[i, sorted((j for j in range(21) if j != i), key=lambda j: (d[i, j], j))[:4]] = 1
    got = np.zeros((21, 21))
    for r in density.affinity(points, 4, itself=False).collect():
        got[r.id, r.other] = r.w
    assert (got == (one + one.T) / 2).all() and not got.diagonal().any()


def test_kmeans_of_leading_coordinates_together(spark):
    from tidemark.operators.sweeps import Starts, labelled

    x = np.random.default_rng(9).standard_normal((60, 4)) * [5, 3, 1, 1]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    fits = Starts(points, [2, 3, 4, 5], 2, leading=True).run()
    rows = labelled(fits.points, [fits.centres[fits.best()[k, -1]] for k in (2, 3, 4, 5)]).orderBy("id").collect()
    for j, k in enumerate((2, 3, 4, 5)):
        own = points.select("id", F.slice("x", 1, k).alias("x"))
        alone = Starts(own, [k], 2).run()
        assert np.allclose([c for c, n in zip(fits.cost, fits.names) if n[0] == k], alone.cost)
        want = labelled(alone.points, [alone.centres[alone.best()[k, -1]]]).orderBy("id").collect()
        assert [r.labels[j] for r in rows] == [r.labels[0] for r in want]
