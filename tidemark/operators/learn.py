"""Models: scaling, PCA, k-means, size-balanced k-means, mixtures, gap statistic, spectral clustering, classifiers.

Points are (id, x array<double>). Axes and forests are those of ``pyspark.ml``; grids of models (k, covariance, start) are advanced
together by scans of the points, see ``sweeps`` and ``sizes``.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship
from .blocks import numbered
from .near import columns
from .regimes import canonical
from .sizes import fit as fit_sizes
from .spectra import leading
from .sweeps import Starts, labelled, mixtures, scores, silhouettes, totals

_SCORES = ("inertia", "silhouette", "calinski_harabasz", "davies_bouldin")


def standardize(points: DataFrame) -> DataFrame:
    """Coordinates less their mean over their population deviation; a constant coordinate is divided by 1.

    Means and deviations are two aggregates by coordinate; vectors are scaled where they are and never shuffled.
    """
    d = points.agg(F.max(F.size("x"))).first()[0] or 0
    parts = [f(F.col("x")[j]).alias(f"{n}{j}") for j in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    found = points.agg(*parts).first() if d else {}
    means = F.array(*(F.lit(found[f"m{j}"]) for j in range(d)))
    widths = F.array(*(F.lit(found[f"s{j}"] or 1.0) for j in range(d)))
    centred = F.zip_with("x", means, lambda v, m: v - m)
    return points.withColumn("x", F.zip_with(centred, widths, lambda v, w: v / w))


def pca(points: DataFrame, n: int = 5) -> DataFrame:
    """Scores on the first ``n`` axes of the standardised points; each axis points to where its largest loading is positive."""
    scaled = standardize(points.select("id", "x"))
    model = PCA(k=n, inputCol="v", outputCol="s").fit(scaled.select("id", array_to_vector("x").alias("v")))
    axes = model.pc.toArray()
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    dot = lambda a: F.aggregate(F.zip_with("x", F.array(*map(F.lit, a.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return points.drop("x").join(scaled.select("id", F.array(*(dot(axes[:, k]) for k in range(n))).alias("x")), "id")


def explained(points: DataFrame, n: int = 5) -> list[float]:
    scaled = standardize(points.select("id", "x"))
    return PCA(k=n, inputCol="v", outputCol="s").fit(scaled.select(array_to_vector("x").alias("v"))).explainedVariance.toArray().tolist()


def gram(points: DataFrame) -> np.ndarray:
    """Sums over points of products of two coordinates: each task sums its own, a row a coordinate is shuffled."""

    def part(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.array([np.asarray(v, float) for v in pdf.x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    ship(points.sparkSession)
    sums = points.select("x").mapInPandas(part, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    if not sums:
        raise ValueError("no points")
    n = max(r.i for r in sums) + 1
    out = np.zeros((n, n))
    for r in sums:
        out[r.i, r.j] = r.g
    return out


def svd_scores(points: DataFrame, n: int = 5) -> DataFrame:
    """(id, pca, svd): scores on the first ``n`` principal axes, and left singular vectors times singular values of the
    standardised matrix, by the eigenvectors of its Gram matrix; each axis points as in ``pca``."""
    scaled = standardize(points.select("id", "x")).select("id", "x")
    axes = np.linalg.eigh(gram(scaled))[1][:, ::-1][:, :n]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    dot = lambda a: F.aggregate(F.zip_with("x", F.array(*map(F.lit, a.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    own = scaled.select("id", F.array(*(dot(axes[:, k]) for k in range(axes.shape[1]))).alias("svd"))
    return pca(points.select("id", "x"), n).withColumnRenamed("x", "pca").join(own, "id").select("id", "pca", "svd")


def kmeans(points: DataFrame, k: int, seeds: int = 50) -> DataFrame:
    """(id, label) of the cheapest of several starts, numbered by the mean of the first coordinate."""
    fits = Starts(points, [k], seeds).run()
    out = labelled(points.select("id", "x"), [fits.centres[fits.best()[k, -1]]])
    return canonical(out.select("id", F.col("x")[0].alias("pc1"), F.col("labels")[0].alias("label"))).select("id", "label")


def kmeans_sweep(points: DataFrame, ks: range = range(2, 13), seeds: int = 50) -> DataFrame:
    """(k, inertia, silhouette, calinski_harabasz, davies_bouldin); all starts of all k are advanced together."""
    fits = Starts(points, ks, seeds).run()
    best = fits.best()
    found = scores(labelled(fits.points, [fits.centres[best[k, -1]] for k in ks]), list(ks))
    rows = [(k, *(r[c] for c in _SCORES)) for k, r in zip(ks, found)]
    return points.sparkSession.createDataFrame(rows, "k int, " + ", ".join(f"{c} double" for c in _SCORES))


def balanced_kmeans(points: DataFrame, k: int = 5, seeds: int = 20, slack: int = 2) -> DataFrame:
    """(id, label) with sizes within ``slack`` of n // k, numbered by the mean of the first coordinate; any number of points.
    Equal points may go to different clusters where the sizes ask for it. No points are an error."""
    rows, found = fit_sizes(points, k, seeds, slack)
    return canonical(found.labelled(rows)).select("id", "label")


def gmm_parameters(k: int, d: int, kind: str) -> int:
    return k * d + k - 1 + {"diag": k * d, "tied": d * (d + 1) // 2, "full": k * d * (d + 1) // 2}[kind]


def gmm_sweep(points: DataFrame, ks: range = range(2, 10), kinds: tuple[str, ...] = ("diag", "tied", "full"), seeds: int = 10) -> DataFrame:
    """(k, covariance, log_likelihood, bic, aic, weights, means, covariances) of the best start; a fit that fails is left out.

    Covariances are flat: diagonals, one matrix, or one after another.
    """
    scaled = standardize(points.select("id", "x")).select("id", "x")
    head = scaled.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not head.n:
        raise ValueError("no points")
    grid = [(k, kind) for k in ks for kind in kinds]
    rows = []
    for (k, kind), (ll, m) in sorted(mixtures(scaled, grid, seeds).items()):
        p = gmm_parameters(k, head.d, kind)
        rows.append((k, kind, ll, -2 * ll * head.n + p * math.log(head.n), -2 * ll * head.n + 2 * p, m.weights.tolist(), m.means.tolist(), m.cov.ravel().tolist()))
    return points.sparkSession.createDataFrame(rows, "k int, covariance string, log_likelihood double, bic double, aic double, weights array<double>, means array<array<double>>, covariances array<double>")


def select_gmm(sweep: DataFrame) -> DataFrame:
    """(k, covariance) of the least BIC, ties by k and name. A table without any BIC is an error."""
    if sweep.filter("bic is not null").isEmpty():
        raise ValueError("no mixture has a BIC")
    return sweep.filter("bic is not null").agg(F.min_by(F.struct("k", "covariance"), F.struct("bic", "k", "covariance")).alias("s")).select("s.k", "s.covariance")


def gmm_labels(points: DataFrame, k: int, kind: str = "full", seeds: int = 10) -> DataFrame:
    """(id, label, probabilities): hard labels numbered by the first coordinate; probabilities in the model's own order."""
    scaled = standardize(points.select("id", "x")).select("id", "x")
    found = mixtures(scaled, [(k, kind)], seeds)
    if not found:
        raise ValueError("no mixture could be fitted")
    mixture = found[k, kind][1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = columns(batch)
                resp, _ = mixture.responsibilities(rows["x"])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(resp.argmax(1), pa.int32()), pa.array(rows["x"][:, 0]), pa.array(list(resp), pa.list_(pa.float64()))], names=["id", "label", "pc1", "probabilities"])

    return canonical(scaled.mapInArrow(run, "id long, label int, pc1 double, probabilities array<double>")).select("id", "label", "probabilities")


def gap_statistic(points: DataFrame, ks: range = range(2, 12), boots: int = 10, starts: int = 20, seed: int = 42) -> DataFrame:
    """(k, gap, gap_std, gap_sk, optimal). Models of the points and of all reference sets are advanced together; a reference
    point follows from seed, set and id, so sets are made where the points are."""
    if not len(ks) or points.limit(2).count() < 2:
        raise ValueError("two points and one k at least are needed")
    fits = Starts(points, ks, starts, range(-1, boots), seed).run()
    rows = [(k, b, math.log(fits.cost[m] + 1e-12)) for (k, b), m in fits.best().items()]
    logs = points.sparkSession.createDataFrame(rows, "k int, boot long, log_w double")
    each = logs.groupBy("k").agg(
        (F.avg(F.when(F.col("boot") >= 0, F.col("log_w"))) - F.max(F.when(F.col("boot") < 0, F.col("log_w")))).alias("gap"),
        F.coalesce(F.stddev_samp(F.when(F.col("boot") >= 0, F.col("log_w"))), F.lit(0.0)).alias("gap_std"),
    ).withColumn("gap_sk", F.col("gap_std") * math.sqrt(1 + 1 / boots))
    w = Window.orderBy("k")
    ok = F.coalesce(F.col("gap") >= F.lead("gap").over(w) - F.lead("gap_sk").over(w), F.lit(True))
    return each.withColumn("ok", ok).withColumn("optimal", F.col("ok") & (F.sum(F.col("ok").cast("int")).over(w) == 1)).drop("ok")


def embedding(points: DataFrame, k: int, neighbors: int = 10, itself: bool = True) -> DataFrame:
    """(id, x): leading eigenvectors of the normalised kNN affinity over the square roots of degrees. No points are an error."""
    from .density import affinity

    edges = affinity(points.select("id", "x"), neighbors, itself).checkpoint()
    degrees = edges.groupBy("id").agg(F.sum("w").alias("degree")).checkpoint()
    scale = degrees.select("id", F.sqrt("degree").alias("root")).checkpoint()
    scaled = edges.join(scale, "id").join(scale.select(F.col("id").alias("other"), F.col("root").alias("root2")), "other")
    _, vectors = leading(scaled.select("id", "other", (F.col("w") / F.col("root") / F.col("root2")).alias("w")).checkpoint(), k)
    return vectors.join(scale, "id").select("id", F.transform("x", lambda v: v / F.col("root")).alias("x")).checkpoint()


def _spectral(embedded: DataFrame, ks: list[int], starts: int) -> DataFrame:
    """(id, x, labels): of each k the cheapest k-means on the first k eigenvectors; all starts of all k are advanced together."""
    fits = Starts(embedded, ks, starts, leading=True).run()
    best = fits.best()
    return labelled(fits.points, [fits.centres[best[k, -1]] for k in ks])


def spectral(points: DataFrame, k: int, neighbors: int = 10, starts: int = 10) -> DataFrame:
    """(id, label): leading eigenvectors of the normalised affinity, then k-means; numbered by the first coordinate."""
    found = _spectral(embedding(points, k, neighbors), [k], starts).select("id", F.col("labels")[0].alias("label"))
    return canonical(points.select("id", F.col("x")[0].alias("pc1")).join(found, "id")).select("id", "label")


def optimize_components(points: DataFrame, ns: range = range(3, 11), k: int = 5, seeds: int = 50) -> DataFrame:
    """(n, explained_pct, silhouette, davies_bouldin, calinski_harabasz, inertia) of k-means on the standardised scores of the
    first n axes; n of as many as rows or coordinates are passed over. The axes are found once; starts of all n are advanced
    together, and blocks of points meet once for all silhouettes."""
    first = points.first()
    if first is None:
        raise ValueError("no points")
    if k < 2:
        raise ValueError("two clusters at least are needed")
    usable = [n for n in ns if n < min(len(first.x), points.count())]
    if not usable:
        raise ValueError("no number of components is below the rows and coordinates")
    ensure_checkpoint_dir(points.sparkSession)
    share = np.cumsum(explained(points, max(usable)))
    every = standardize(pca(points.select("id", "x"), max(usable))).checkpoint()
    fits = Starts(every, [k], seeds, first=usable).run()
    found = scores(labelled(fits.points, [fits.centres[fits.best(n)[k, -1]] for n in usable]), [k] * len(usable), usable)
    rows = [(n, round(float(share[n - 1]) * 100, 2), *(r[c] for c in ("silhouette", "davies_bouldin", "calinski_harabasz", "inertia"))) for n, r in zip(usable, found)]
    return points.sparkSession.createDataFrame(rows, "n int, explained_pct double, silhouette double, davies_bouldin double, calinski_harabasz double, inertia double")


def loadings(points: DataFrame, n: int = 5) -> DataFrame:
    """(feature, component, pca, svd): absolute loadings by eigenvectors of the correlations and by the singular vectors of
    the standardised matrix, which agree up to sign. The Gram matrix is summed by Spark; the driver sees coordinates squared."""
    scaled = standardize(points.select("id", "x"))
    axes = np.abs(PCA(k=n, inputCol="v", outputCol="s").fit(scaled.select(array_to_vector("x").alias("v"))).pc.toArray())
    singular = np.abs(np.linalg.eigh(gram(scaled))[1][:, ::-1][:, :n])
    rows = [(f, c + 1, float(axes[f, c]), float(singular[f, c])) for f in range(axes.shape[0]) for c in range(n)]
    return points.sparkSession.createDataFrame(rows, "feature int, component int, pca double, svd double")


def label_summaries(points: DataFrame) -> list[tuple[int, int, float, float | None]]:
    """(n_clusters, n_noise, noise_pct, silhouette) of each of ``labels`` (an array by point; under 0 is noise); the last is
    null under two clusters. Blocks of points meet once for all of them."""
    width = points.agg(F.max(F.size("labels")).alias("n"), F.max(F.array_max("labels")).alias("top")).first()
    size = (width.top or 0) + 1

    def count(ids, x, labels):
        for j in range(labels.shape[1]):
            yield j, np.bincount(labels[:, j] + 1, minlength=size + 1).astype(float)

    found = totals(points, count, "labels")
    counts = [found[j][1:] for j in range(width.n)]
    out = []
    for j, s in enumerate(silhouettes(points, counts)):
        clusters, noise, n = int((counts[j] > 0).sum()), int(found[j][0]), int(found[j].sum())
        out.append((clusters, noise, round(100 * noise / n, 1), s if clusters >= 2 else None))
    return out


def sweep(points: DataFrame, name: str, values, make) -> DataFrame:
    """(``name``, n_clusters, n_noise, noise_pct, silhouette) of ``make(points, value)`` for each value."""
    ensure_checkpoint_dir(points.sparkSession)
    own = points.select("id", "x")
    for j, v in enumerate(values):
        own = own.join(make(points, v).select("id", F.col("label").alias(f"l{j}")), "id")
    return _summaries(own.select("id", "x", F.array(*(f"l{j}" for j in range(len(values)))).alias("labels")).checkpoint(), name, values)


def _summaries(own: DataFrame, name: str, values) -> DataFrame:
    kind = float if any(isinstance(v, float) for v in values) else int
    rows = [(kind(v), *r) for v, r in zip(values, label_summaries(own))]
    return own.sparkSession.createDataFrame(rows, f"{name} {'double' if kind is float else 'int'}, n_clusters long, n_noise long, noise_pct double, silhouette double")


def dbscan_sweep(points: DataFrame, eps=(0.5, 1.0, 1.5, 2.0, 2.5, 3.0), min_samples: int = 5) -> DataFrame:
    from .density import dbscan

    return sweep(points, "eps", eps, lambda p, e: dbscan(p.select("id", "x"), e, min_samples))


def hdbscan_sweep(points: DataFrame, sizes=(5, 10, 15, 20)) -> DataFrame:
    """``sweep`` of HDBSCAN for each least size; blocks and nearest points are found once, for the largest."""
    from .hierarchy import Hdbscan

    own = Hdbscan(points, max(sizes))
    return sweep(points, "min_size", sizes, lambda _, n: own.labels(n))


def spectral_sweep(points: DataFrame, ks: range = range(2, 8), neighbors: int = 10, starts: int = 10) -> DataFrame:
    """As ``sweep``, of spectral clusters for each k; the graph, in which a point has ``neighbors`` others, and its eigenvectors
    are found once, for the largest, and clusters of all k together."""
    found = _spectral(embedding(points, max(ks), neighbors, itself=False), list(ks), starts).select("id", "labels")
    return _summaries(points.select("id", "x").join(found, "id").checkpoint(), "k", ks)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    """A saved forest or tree."""
    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession

    kind = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())["class"]
    from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel

    return (RandomForestClassificationModel if "RandomForest" in kind else DecisionTreeClassificationModel).load(path)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``weight``: n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return df.join(counts, label).crossJoin(F.broadcast(whole)).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def train_classifier(df: DataFrame, kind: str = "rf", trees: int = 200, depth: int | None = None, balanced: bool = True, seed: int = 42):
    """``df`` is (…, x, label). A forest of balanced weights, or one plain tree; another kind is an error."""
    rows = df.withColumn("features", array_to_vector("x"))
    if kind == "rf":
        rows = class_weights(rows) if balanced else rows
        more = {"weightCol": "weight"} if balanced else {}
        return RandomForestClassifier(numTrees=trees, maxDepth=depth or 12, seed=seed, **more).fit(rows)
    if kind == "dt":
        return DecisionTreeClassifier(maxDepth=depth or 8, seed=seed).fit(rows)
    raise ValueError(f"unknown kind {kind!r}")


def train_current_regime(df: DataFrame, **how):
    return train_classifier(df, "rf", **how)


def train_decision_tree(df: DataFrame, **how):
    return train_classifier(df, "dt", **how)


def train_with_metrics(df: DataFrame, names: list[str], kind: str = "dt", splits: int = 5, **how) -> tuple[object, dict]:
    """An unweighted tree or forest on all rows, and its metrics: accuracy by fold in time order, mean, deviation, importances."""
    how = {"kind": kind, "balanced": False} | how
    scores = fold_scores(df, splits, **how)
    model = train_classifier(df, **how)
    found = {"cv_accuracies": scores, "mean_cv_accuracy": float(np.mean(scores)), "std_cv_accuracy": float(np.std(scores))}
    return model, found | {"feature_importances": importances(model, names, df.sparkSession)}


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df.withColumn("features", array_to_vector("x"))).select(*df.columns, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("probabilities"))


def predict_current(model, df: DataFrame) -> DataFrame:
    """Latest row: (date, predicted, label, prob), one row a class."""
    last = df.orderBy(F.desc("date")).limit(1)
    return predict(model, last).select("date", "predicted", F.posexplode("probabilities").alias("label", "prob"))


def forward_targets(df: DataFrame, horizon: int, label: int) -> DataFrame:
    """``label`` becomes whether the regime ``horizon`` rows later is the given one; rows without such a row go."""
    rows = numbered(df, "date")
    ahead = rows.filter("label is not null").select((F.col("_rn") - horizon).alias("_rn"), F.col("label").alias("_ahead"))
    return rows.join(ahead, "_rn").withColumn("label", (F.col("_ahead") == label).cast("int")).select(*df.columns)


def _side_by_side(fn: Callable, jobs: list, most: int = 4) -> list:
    """``fn`` of every job, a few at a time: Spark runs small fits together that alone leave tasks idle. Results are in order."""
    with ThreadPoolExecutor(min(most, max(1, len(jobs)))) as pool:
        return list(pool.map(lambda job: fn(*job), jobs))


def train_forward(df: DataFrame, horizons: tuple[int, ...] = (1, 2, 4, 8), trees: int = 200, depth: int = 30) -> dict:
    """{horizon: {label: model}}: a forest for each regime at each horizon; a target of one class only has no model."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()  # read by every fit
    labels = [r.label for r in df.select("label").distinct().orderBy("label").collect()]

    def fit(h: int, k):
        rows = forward_targets(df, h, k)
        return train_classifier(rows, trees=trees, depth=depth) if rows.select("label").distinct().count() == 2 else None

    jobs = [(h, k) for h in horizons for k in labels]
    out: dict = {h: {} for h in horizons}
    for (h, k), model in zip(jobs, _side_by_side(fit, jobs)):
        if model is not None:
            out[h][k] = model
    return out


def fold_scores(df: DataFrame, splits: int = 5, **how) -> list[float]:
    """Accuracy of each fold in time order."""
    from .metrics import time_series_split

    folds = time_series_split(df, splits).persist()

    def score(k: int) -> float:
        own = folds.filter(F.col("fold") == k)
        model = train_classifier(own.filter("role = 'train'").drop("fold", "role"), **how)
        return predict(model, own.filter("role = 'test'")).agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0]

    scores = _side_by_side(score, [(k,) for k in range(1, splits + 1)])
    folds.unpersist()
    return scores


def cross_validate(df: DataFrame, splits: int = 5, **how) -> tuple[float, float]:
    """Mean and population deviation of accuracy over folds in time order."""
    scores = fold_scores(df, splits, **how)
    return float(np.mean(scores)), float(np.std(scores))


def importances(model, names: list[str], spark) -> DataFrame:
    if not hasattr(model, "featureImportances"):
        raise ValueError("the model has no importances")
    values = model.featureImportances.toArray().tolist()
    if len(values) != len(names):
        raise ValueError(f"{len(values)} importances, {len(names)} names")
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def saved_importances(spark, path: str, names: list[str]) -> DataFrame:
    """``importances`` of a saved model; a missing one is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(path)
    if not names:
        raise ValueError("no names of features")
    return importances(load_model(path), names, spark)
