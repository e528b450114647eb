"""Quality of clusterings and classifiers. Points are (id, label, x array<double>); noise has label -1.

Measures over pairs compare every point with every other, which is what they are defined by, in blocks of fixed size, and
take any number of points, as measures over centres do.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance, squared_distance
from ..session import ensure_checkpoint_dir
from .blocks import numbered
from .near import Placed, visit
from .sweeps import _Each, scores

def _mean_vector(x: str = "x") -> Column:
    return F.avg(x)


def centers(points: DataFrame) -> DataFrame:
    """(label, n, c array<double>): means by coordinate, partially aggregated."""
    parts = points.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return parts.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


def inertia(points: DataFrame) -> DataFrame:
    own = points.join(centers(points), "label")
    return own.agg(F.sum(squared_distance(F.col("x"), F.col("c"))).alias("inertia"))


def silhouettes(points: DataFrame) -> DataFrame:
    """(id, label, s): Euclidean; 0 where a label has one point."""

    counts = points.filter("label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # a row a cluster
    spark, kind = points.sparkSession, points.schema["label"].dataType.simpleString()
    if not counts:
        return points.select("id", "label", F.lit(0.0).alias("s")).limit(0)
    codes = spark.createDataFrame([(r.label, i) for i, r in enumerate(counts)], f"label {kind}, code int")
    coded = points.select("id", "label", "x").join(F.broadcast(codes), "label").select("id", "x", F.array("code").alias("labels"))
    placed, n = Placed(coded), [np.array([float(r.n) for r in counts])]
    widths = [placed.bounds.pivots.shape[1]]
    found = visit(placed.rows, placed.near(math.inf), lambda own: _Each(own, n, widths), "id long, code int, s double")
    return found.join(F.broadcast(codes), "code").select("id", "label", "s")


def calinski_harabasz(points: DataFrame) -> DataFrame:
    within = inertia(points).select(F.col("inertia").alias("w"))
    c = centers(points)
    whole = centers(points.withColumn("label", F.lit(0))).select(F.col("c").alias("g"))
    between = c.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * squared_distance(F.col("c"), F.col("g"))).alias("b"), F.sum("n").alias("n"), F.count("*").alias("k"))
    score = F.when(F.col("w") == 0, 1.0).otherwise(F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)))
    return between.crossJoin(F.broadcast(within)).select(score.alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    c = centers(points)
    spread = points.join(c, "label").groupBy("label", "c").agg(F.avg(distance(F.col("x"), F.col("c"))).alias("s"))
    a, b = spread.select("label", "s", "c"), spread.select(F.col("label").alias("l2"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    pairs = a.crossJoin(F.broadcast(b)).filter("label <> l2")
    worst = pairs.groupBy("label").agg(F.max(F.coalesce(F.try_divide(F.col("s") + F.col("s2"), distance(F.col("c"), F.col("c2"))), F.lit(0.0))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def rand_index(labels: DataFrame) -> DataFrame:
    """(a, b, ari) for all pairs of methods; labels is (id, method, label), noise left out, NULL under 2 common points."""
    own = labels.filter("label >= 0")
    a, b = own.select("id", F.col("method").alias("a"), F.col("label").alias("la")), own.select("id", F.col("method").alias("b"), F.col("label").alias("lb"))
    cells = a.join(b, "id").groupBy("a", "b", "la", "lb").agg(F.count("*").alias("n"))
    c2 = lambda n: n * (n - 1) / 2
    rows = cells.groupBy("a", "b", "la").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum(c2(F.col("n"))).alias("ra"), F.sum("n").alias("n"))
    cols = cells.groupBy("a", "b", "lb").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum(c2(F.col("n"))).alias("rb"))
    both = cells.groupBy("a", "b").agg(F.sum(c2(F.col("n"))).alias("same"))
    all_ = both.join(rows, ["a", "b"]).join(cols, ["a", "b"])
    expected = F.try_divide(F.col("ra") * F.col("rb"), c2(F.col("n")))
    top = (F.col("ra") + F.col("rb")) / 2
    ari = F.when(F.col("n") < 2, None).when(top == expected, 1.0).otherwise(F.try_divide(F.col("same") - expected, top - expected))
    return all_.select("a", "b", ari.alias("ari"))


def compare_methods(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a method: clusters, noise, silhouette, Davies-Bouldin, Calinski-Harabasz, over the points that are no noise.

    labels is (id, method, label). Methods are few: a plan for each, joined by a union; blocks of points meet once for all of them.
    """
    methods = [r.method for r in labels.select("method").distinct().orderBy("method").collect()]
    own = labels.filter("label >= 0")
    codes = {m: {r.label: i for i, r in enumerate(own.filter(F.col("method") == m).groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect())} for m in methods}
    wide = own.select("id", "method", "label").groupBy("id").pivot("method", methods).agg(F.max("label")) if methods else None
    if wide is None:
        raise ValueError("no methods")
    spark = points.sparkSession
    every = points.select("id", "x").join(wide, "id")
    for i, m in enumerate(methods):
        named = spark.createDataFrame(sorted((int(l), c) for l, c in codes[m].items()), f"_l{i} long, _c{i} int")
        every = every.withColumn(f"_l{i}", F.col(f"`{m}`").cast("long")).join(F.broadcast(named), f"_l{i}", "left")
    every = every.select("id", "x", F.array(*(F.coalesce(f"_c{i}", F.lit(-1)) for i in range(len(methods)))).alias("labels"))
    ensure_checkpoint_dir(spark)
    every = every.checkpoint()
    found = scores(every, [max(1, len(codes[m])) for m in methods])
    out = None
    for i, m in enumerate(methods):
        head = labels.filter(F.col("method") == m).agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"), F.count_if(F.col("label") < 0).alias("noise"))
        enough = F.col("clusters") >= 2
        row = head.select(F.lit(m).alias("method"), "clusters", "noise", *(F.when(enough, F.lit(found[i][c])).cast("double").alias(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")))
        out = row if out is None else out.unionByName(row)
    return out


def confusion(df: DataFrame) -> DataFrame:
    """(actual, predicted, n) on the dense grid of all classes."""
    ids = df.select(F.col("actual").alias("c")).union(df.select("predicted")).distinct()
    grid = ids.select(F.col("c").alias("actual")).crossJoin(ids.select(F.col("c").alias("predicted")))
    counts = df.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def report(df: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support), with rows macro and weighted; 0 where a divisor is 0."""
    cells = confusion(df)
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    by_actual = cells.groupBy(F.col("actual").alias("k")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    by_pred = cells.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("found"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = by_actual.join(by_pred, "k").select(F.col("k").cast("string").alias("class"), zero(F.col("tp"), F.col("found")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), "support")
    rows = rows.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    macro = rows.agg(*(F.avg(c).alias(c) for c in names), F.sum("support").alias("support")).withColumn("class", F.lit("macro"))
    weighted = rows.agg(*(zero(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names), F.sum("support").alias("support")).withColumn("class", F.lit("weighted"))
    return rows.unionByName(macro).unionByName(weighted).select("class", *names, "support")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of common ids with equal labels."""
    both = a.select("id", F.col("label").alias("la")).join(b.select("id", F.col("label").alias("lb")), "id")
    return both.agg(F.avg((F.col("la") == F.col("lb")).cast("int")).alias("agreement"), F.count("*").alias("n"))


def time_series_split(df: DataFrame, splits: int = 5, order: str = "date") -> DataFrame:
    """(fold, role, …): test blocks of n // (splits + 1) rows at the end, each trained on all rows before it."""
    rows = numbered(df, order)
    size = rows.agg(F.count("*").alias("_n"))
    folds = rows.crossJoin(F.broadcast(size)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    test = F.floor(F.col("_n") / (splits + 1))
    begin = F.col("_n") - (splits - F.col("fold") + 1) * test
    role = F.when(F.col("_rn") < begin, "train").when(F.col("_rn") < begin + test, "test")
    return folds.withColumn("role", role).filter("role is not null").select("fold", "role", *df.columns)


def holdout(df: DataFrame, share: float = 0.2, order: str = "date") -> DataFrame:
    """``role``: the last ceil(share * n) rows are test rows."""
    rows = numbered(df, order)
    size = rows.agg(F.count("*").alias("_n"))
    return rows.crossJoin(F.broadcast(size)).withColumn("role", F.when(F.col("_rn") < F.col("_n") - F.ceil(F.col("_n") * share), "train").otherwise("test")).select("role", *df.columns)


def optimal_gap_k(scores: DataFrame) -> DataFrame:
    """First k whose gap reaches the next gap less its error, else the last; scores is (k, gap, s)."""
    w = Window.orderBy("k")
    rows = scores.select("k", ((F.col("gap") >= F.lead("gap").over(w) - F.lead("s").over(w))).alias("ok"))
    return rows.agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("k"))), F.max("k")).alias("best_k"))


def knee_k(scores: DataFrame) -> DataFrame:
    """The k of the greatest second difference of inertia: gradients of gradients with unit steps, first of ties."""
    w = Window.orderBy("k")

    def grad(c: str) -> Column:
        f, f0, f1 = F.col(c), F.lag(c).over(w), F.lead(c).over(w)
        return F.when(f0.isNull(), f1 - f).when(f1.isNull(), f - f0).otherwise((f1 - f0) / 2)

    twice = scores.withColumn("g", grad("inertia")).withColumn("g2", grad("g"))
    return twice.agg(F.max_by("k", F.struct("g2", -F.col("k"))).alias("knee_k"))


def pick_k(scores: DataFrame, cap: int) -> DataFrame:
    return scores.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k")).select(F.least("k", F.lit(cap)).alias("best_k"))


def recommend_features(importances: DataFrame, current: DataFrame, top: int = 35) -> DataFrame:
    """Current features with importance, rank and whether they are among the best; those without importance rank behind all."""
    ranked = importances.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    n = importances.agg(F.count("*").alias("n"))
    both = current.select("feature").join(ranked, "feature", "left").crossJoin(F.broadcast(n))
    return both.select("feature", "importance", F.coalesce("rank", F.col("n") + 1).cast("long").alias("rank"), (F.coalesce("rank", F.lit(2**30)) <= top).alias("recommended"))
