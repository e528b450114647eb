"""Models against what defines them: numpy decompositions, costs and criteria recomputed."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hierarchy, learn, metrics

from . import plain


def frame(spark, x, label=None):
    rows = [(i, 0 if label is None else int(label[i]), v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, label int, x array<double>")


def blobs(seed, n=40, dims=4, k=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 5, dims) + rng.standard_normal((n, dims)) * rng.uniform(0.3, 1, dims) for _ in range(k)])


def scaled(x):
    return (x - x.mean(0)) / x.std(0)


def test_pca_and_svd_against_numpy(spark):
    x = blobs(1, dims=6)
    u, s, vt = np.linalg.svd(scaled(x), full_matrices=False)
    out = learn.svd_scores(frame(spark, x), 3).orderBy("id").collect()
    for name in ("pca", "svd"):
        got = np.array([r[name] for r in out])
        want = (u * s)[:, :3]
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    axes = vt[:3].T * np.where(vt[:3].T[np.abs(vt[:3].T).argmax(0), np.arange(3)] < 0, -1, 1)
    assert np.allclose(np.array([r.pca for r in out]), scaled(x) @ axes, atol=1e-8)
    both = learn.loadings(frame(spark, x), 3).orderBy("component", "feature").collect()
    assert np.allclose([r.pca for r in both], np.abs(vt[:3]).ravel()) and np.allclose([r.svd for r in both], np.abs(vt[:3]).ravel())
    assert np.allclose(learn.explained(frame(spark, x), 3), (s**2 / (s**2).sum())[:3])


def test_components_sweep(spark):
    x = blobs(2, dims=5)
    rows = learn.optimize_components(frame(spark, x), range(3, 9), 3, 2).orderBy("n").collect()
    s = np.linalg.svd(scaled(x), compute_uv=False) ** 2
    assert [r.n for r in rows] == [3, 4] and np.allclose([r.explained_pct for r in rows], 100 * np.cumsum(s / s.sum())[2:4], atol=0.006)
    assert all(r.silhouette > 0.3 and r.calinski_harabasz > 50 and 0 < r.davies_bouldin < 2 for r in rows)
    for bad in (dict(ns=range(7, 9)), dict(k=1)):
        with pytest.raises(ValueError):
            learn.optimize_components(frame(spark, x), **bad)
    with pytest.raises(ValueError):
        learn.optimize_components(frame(spark, x).limit(0))


def test_components_are_swept_together(spark, monkeypatch):
    """One grid of starts and one meeting of blocks for all numbers of axes, with the scores that each has alone."""
    from tidemark.operators import sweeps

    made = []
    monkeypatch.setattr(learn, "Starts", lambda *a, **b: made.append(sweeps.Starts(*a, **b)) or made[-1])
    x = blobs(5, dims=6)
    rows = learn.optimize_components(frame(spark, x), range(3, 6), 3, 4).orderBy("n").collect()
    assert len(made) == 1 and [r.n for r in rows] == [3, 4, 5]
    every = learn.standardize(learn.pca(frame(spark, x).select("id", "x"), 5)).checkpoint()
    for r in rows:
        own = every.select("id", F.slice("x", 1, r.n).alias("x"))
        fits = sweeps.Starts(own, [3], 4).run()
        labelled = sweeps.labelled(own, [fits.centres[fits.best()[3, -1]]]).select("id", "x", F.col("labels")[0].alias("label"))
        assert r.inertia == pytest.approx(metrics.inertia(labelled).first()[0])
        assert r.silhouette == pytest.approx(metrics.silhouettes(labelled).agg(F.avg("s")).first()[0])
        assert r.davies_bouldin == pytest.approx(metrics.davies_bouldin(labelled).first()[0])


def test_groups_of_models_count_each_point_once():
    """Sums by products of matrices are those of the nearest centres; of equally near centres the first has the point."""
    from tidemark.operators.sweeps import Group

    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (300, 3)).astype(float)
    centres = [rng.integers(0, 4, (4, 3)).astype(float) for _ in range(5)]
    found = Group(list(range(5)), centres, np.array([2.0, 2, 2])).sums((x - 2).T.copy())
    for m, c in enumerate(centres):
        d = ((x[:, None] - c) ** 2).sum(2)
        own = np.eye(4)[d.argmin(1)]
        assert np.allclose(found[:, m, -1], own.sum(0)) and np.allclose(found[:, m, :-1], own.T @ (x - 2))
        assert Group([0], [c], np.zeros(3)).cost(x)[0] == d.min(1).sum()


def test_kmeans_cost(spark):
    """Labels are each point's nearest mean, and no single restart of plain Lloyd is better by much."""
    x = blobs(3)
    points = frame(spark, x)
    y = np.array([r.label for r in learn.kmeans(points.select("id", "x"), 3, 3).orderBy("id").collect()])
    c = np.array([x[y == k].mean(0) for k in range(3)])
    cost = ((x - c[y]) ** 2).sum()
    assert (((x[:, None] - c) ** 2).sum(2).argmin(1) == y).all()
    assert cost <= 1.001 * min(plain.lloyd(x, 3, np.random.default_rng(s))[1] for s in range(10))
    assert metrics.inertia(frame(spark, x, y)).first()[0] == pytest.approx(cost)
    assert list(np.argsort([x[y == k][:, 0].mean() for k in range(3)])) == [0, 1, 2]


def test_balanced_sizes(spark):
    x = blobs(4, 21)[:-5]
    sizes = [r.n for r in learn.balanced_kmeans(frame(spark, x), 3, 3).groupBy("label").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 58 and all(58 // 3 - 2 <= n <= 58 // 3 + 2 for n in sizes)


@pytest.mark.parametrize("kind", ["diag", "tied", "full"])
def test_mixture_criteria(spark, kind):
    """BIC and AIC from the likelihood of the parameters, which one more step of EM leaves where they are."""
    x = scaled(blobs(5, dims=3))
    row = learn.gmm_sweep(frame(spark, x), range(3, 4), (kind,), 2).first()
    n, d, k = len(x), 3, 3
    w, means, flat = np.array(row.weights) * n, np.array(row.means), np.array(row.covariances)
    cov = {"full": lambda j: flat.reshape(k, d, d)[j], "tied": lambda j: flat.reshape(d, d), "diag": lambda j: np.diag(flat.reshape(k, d)[j])}[kind]
    assert w.sum() == pytest.approx(n)
    dens = np.zeros((n, k))
    for j in range(k):
        c = cov(j)
        diff = x - means[j]
        dens[:, j] = w[j] / n * np.exp(-0.5 * (diff @ np.linalg.inv(c) * diff).sum(1)) / np.sqrt((2 * math.pi) ** d * np.linalg.det(c))
    total = np.log(dens.sum(1)).sum()
    share = dens / dens.sum(1, keepdims=True)
    assert np.allclose(share.sum(0), w, atol=0.05 * n) and np.allclose(share.T @ x / share.sum(0)[:, None], means, atol=0.1)
    count = k * d + k - 1 + {"diag": k * d, "tied": d * (d + 1) // 2, "full": k * d * (d + 1) // 2}[kind]
    assert row.log_likelihood * n == pytest.approx(total, abs=0.01 * n)
    assert row.bic == pytest.approx(-2 * row.log_likelihood * n + count * math.log(n)) and row.aic == pytest.approx(-2 * row.log_likelihood * n + 2 * count)


def test_best_mixture(spark):
    x = blobs(6)
    sweep = learn.gmm_sweep(frame(spark, x), range(2, 5), ("diag",), 2).cache()
    best = learn.select_gmm(sweep).first()
    assert best.k == min(sweep.collect(), key=lambda r: r.bic).k
    out = learn.gmm_labels(frame(spark, x), best.k, best.covariance).collect()
    assert all(sum(r.probabilities) == pytest.approx(1) for r in out) and len({r.label for r in out}) == best.k
    with pytest.raises(ValueError):
        learn.gmm_sweep(frame(spark, x).limit(0))
    for bad in (sweep.limit(0), sweep.withColumn("bic", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            learn.select_gmm(bad)


def test_sweep_scores_match_the_single_measures(spark):
    x = blobs(8)
    ks = [2, 4]
    rows = {r.k: r for r in learn.kmeans_sweep(frame(spark, x), ks, 5).collect()}
    for k in ks:
        own = frame(spark, x).select("id", "x").join(learn.kmeans(frame(spark, x), k, 5), "id")
        one = metrics.inertia(own).crossJoin(metrics.silhouettes(own).agg(F.avg("s").alias("silhouette"))).crossJoin(metrics.calinski_harabasz(own)).crossJoin(metrics.davies_bouldin(own)).first()
        for c in ("inertia", "silhouette", "calinski_harabasz", "davies_bouldin"):
            assert rows[k][c] == pytest.approx(one[c])


def test_reference_sets_follow_from_ids(spark):
    from tidemark.operators.sweeps import Starts, uniform

    ids = np.arange(4000)
    u = np.stack([uniform(ids, 1, 2, j) for j in range(3)], 1)
    assert 0 < u.min() and u.max() < 1 and np.allclose(u.mean(0), 0.5, atol=0.03) and np.abs(np.corrcoef(u.T) - np.eye(3)).max() < 0.06
    x = blobs(9)
    costs = [Starts(frame(spark, x).repartition(n), [3], 4, (-1, 0)).run() for n in (2, 5)]
    assert np.allclose(costs[0].cost, costs[1].cost)
    best = min(plain.lloyd(x, 3, np.random.default_rng(s))[1] for s in range(10))
    assert costs[0].cost[costs[0].best()[3, -1]] <= 1.001 * best


def test_errors_and_saved_models(spark, tmp_path):
    empty = frame(spark, np.zeros((0, 2)))
    for fit in (hierarchy.hdbscan, lambda p: learn.spectral(p, 2), learn.balanced_kmeans):
        with pytest.raises(ValueError, match="no points"):
            fit(empty)
    rng = np.random.default_rng(7)
    x = rng.random((60, 3))
    df = frame(spark, x, x[:, 1] > 0.5).withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")))
    model = learn.train_current_regime(df, trees=10, depth=4)
    learn.save_model(model, f"file://{tmp_path}/m")
    found = learn.saved_importances(spark, f"file://{tmp_path}/m", ["a", "b", "c"])
    assert found.first().feature == "b" and found.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    with pytest.raises(FileNotFoundError):
        learn.saved_importances(spark, f"file://{tmp_path}/none", ["a"])
    with pytest.raises(ValueError):
        learn.saved_importances(spark, f"file://{tmp_path}/m", ["a", "b"])
    with pytest.raises(ValueError):
        learn.saved_importances(spark, f"file://{tmp_path}/m", [])
    with pytest.raises(ValueError):
        learn.importances(object(), ["a"], spark)
    _, scores = learn.train_with_metrics(df, ["a", "b", "c"], "rf", 3, trees=5, depth=3)
    assert len(scores["cv_accuracies"]) == 3 and scores["std_cv_accuracy"] == pytest.approx(np.std(scores["cv_accuracies"]))


def brute_summary(x, labels):
    """As it is defined, from all distances; a mean over points that are no noise, a point alone in its cluster counting 0."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    names = sorted(set(labels.tolist()) - {-1})
    noise, s = int((labels == -1).sum()), []
    for i in np.flatnonzero(labels >= 0) if len(names) > 1 else []:
        own = (labels == labels[i]).sum()
        a, b = d[i][labels == labels[i]].sum() / max(own - 1, 1), min(d[i][labels == k].mean() for k in names if k != labels[i])
        s.append((b - a) / max(a, b) if own > 1 else 0.0)
    return len(names), noise, round(100 * noise / len(labels), 1), pytest.approx(np.mean(s)) if s else None


def test_label_summaries_are_plain_numbers(spark):
    """7 of 2,000 points are 0.3 %, as a whole number over another is rounded; numpy's own rounding makes it 0.4."""
    labels = np.arange(2000) % 3
    labels[:7] = -1
    rows = [(i, [float(i % 3), 0.0], [int(k), -1]) for i, k in enumerate(labels)]
    got = learn.label_summaries(spark.createDataFrame(rows, "id long, x array<double>, labels array<int>"))
    assert got == [(3, 7, 0.3, pytest.approx(1.0)), (0, 2000, 100.0, None)]
    assert [[type(v) for v in r] for r in got] == [[int, int, float, float], [int, int, float, type(None)]]


def test_dbscan_sweep(spark):
    from tidemark.operators import density

    x = blobs(10, dims=3)
    eps = (0.05, 0.6, np.float64(1.2), 40)
    got = [tuple(r) for r in learn.dbscan_sweep(frame(spark, x), eps, 4).orderBy("eps").collect()]
    labels = [np.array([r.label for r in density.dbscan(frame(spark, x), e, 4).orderBy("id").collect()]) for e in eps]
    assert got == [(e, *brute_summary(x, y)) for e, y in zip(eps, labels)]
    assert got[0][1:] == (0, 120, 100.0, None) and got[1][1] > 1 and got[-1][1:] == (1, 0, 0.0, None)


def test_spectral_sweep(spark):
    """Blobs far apart are the graph's components, so three clusters are they, and two are one of them and the others."""
    x = np.concatenate([np.random.default_rng(k).normal(9 * k, 0.5, (25 + 5 * k, 3)) for k in range(3)])
    blob = np.repeat(range(3), [25, 30, 35])
    two, three = (tuple(r) for r in learn.spectral_sweep(frame(spark, x), range(2, 4)).orderBy("k").collect())
    assert three == (3, *brute_summary(x, blob)) and three[1:4] == (3, 0, 0.0)
    assert any(two == (2, *brute_summary(x, (blob == k).astype(int))) for k in range(3))


def test_hdbscan_sweep(spark):
    x = np.concatenate([blobs(11, 30, 3), np.random.default_rng(11).uniform(-12, 12, (20, 3))])
    sizes = (5, 12, 80)
    got = [tuple(r) for r in learn.hdbscan_sweep(frame(spark, x), sizes).orderBy("min_size").collect()]
    labels = [np.array([r.label for r in hierarchy.hdbscan(frame(spark, x), n).orderBy("id").collect()]) for n in sizes]
    assert got == [(n, *brute_summary(x, y)) for n, y in zip(sizes, labels)]
    assert got[0][1] > 1 and 0 < got[0][2] < len(x) and got[-1][1:] == (0, len(x), 100.0, None)


def test_spectral_sweep_joins_each_point_to_others(spark, monkeypatch):
    """As the reference's sweep does, which counts no point among its own neighbours; all k are clustered together."""
    from tidemark.operators import density

    given, fits, own, starts = [], [], density.affinity, learn.Starts
    monkeypatch.setattr(density, "affinity", lambda p, k, itself: given.append((k, itself)) or own(p, k, itself))
    monkeypatch.setattr(learn, "Starts", lambda p, ks, n, **more: fits.append((ks, n)) or starts(p, ks, n, **more))
    x = np.concatenate([np.random.default_rng(k).normal(9 * k, 0.5, (14, 2)) for k in range(3)])
    assert learn.spectral_sweep(frame(spark, x), range(2, 4), 5, 3).count() == 2 and given == [(5, False)] and fits == [([2, 3], 3)]


def test_hdbscan_sweep_finds_the_nearest_once(spark, monkeypatch):
    found, own = [], hierarchy.nearest_of
    monkeypatch.setattr(hierarchy, "nearest_of", lambda placed, k: found.append(k) or own(placed, k))
    x = blobs(12, 12, 2)
    assert learn.hdbscan_sweep(frame(spark, x), (4, 7)).count() == 2 and found == [7]
    with pytest.raises(ValueError, match="7"):
        hierarchy.Hdbscan(frame(spark, x), 7).labels(8)


def test_silhouettes_of_many_clusters_and_of_noise_alone(spark, monkeypatch):
    from tidemark.operators import sweeps

    rng = np.random.default_rng(13)
    x, many = rng.standard_normal((90, 2)), rng.integers(-1, 25, 90)
    labels = [many, many % 3 - 1, np.full(90, -1)]
    points = spark.createDataFrame([(i, v.tolist(), [int(y[i]) for y in labels]) for i, v in enumerate(x)], "id long, x array<double>, labels array<int>")
    assert learn.label_summaries(points) == [brute_summary(x, y) for y in labels]
    monkeypatch.setattr(sweeps, "Placed", None)  # nothing is placed where all are noise
    alone = points.withColumn("labels", F.array(F.lit(-1), F.lit(-1)))
    assert learn.label_summaries(alone) == [(0, 90, 100.0, None)] * 2


@pytest.mark.parametrize("name", ["hdbscan_sweep", "spectral_sweep"])
def test_sweeps_cluster_standardised_scores(spark, monkeypatch, name):
    """As the reference's sweeps do, so that each axis counts the same."""
    from tidemark.plans.queries import QUERIES

    given = []
    monkeypatch.setattr(learn, name, lambda points: given.append(points) or points)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    x = np.array([r.x for r in given[0].collect()])
    assert x.shape[1] == 5 and np.allclose(x.mean(0), 0) and np.allclose(x.std(0), 1)


def test_reference_sets_are_made_once_for_groups_of_bounded_size():
    """Groups of models have WIDE centres or one model; a set's points follow from ids as ``uniform`` draws them."""
    from tidemark.operators import sweeps

    fits = object.__new__(sweeps.Starts)
    fits.names = [(k, b, s) for b in (-1, 0, 3) for k in (2, 11) for s in range(20)]
    fits.low, fits.high, fits.seed, fits.widths = np.zeros(2), np.array([1.0, 4]), 42, [2] * len(fits.names)
    rng = np.random.default_rng(0)
    fits.centres = [rng.uniform(0, 1, (k, 2)) for k, _, _ in fits.names]
    ids, x = np.arange(5000, 5300), rng.uniform(0, 1, (300, 2))
    ((_, sets),) = list(fits._sets(list(range(len(fits.names))))(ids, x))
    assert len(sets) == 3 and all(len(g.models) == 1 or len(g.models) * g.k <= sweeps.WIDE for _, _, groups in sets for g in groups)
    assert sorted(m for _, _, groups in sets for g in groups for m in g.models) == list(range(len(fits.names)))
    assert (sets[0][0] == x).all() and np.allclose(sets[2][0], fits.high * np.stack([sweeps.uniform(ids, 42, 3, j) for j in (0, 1)], 1))
