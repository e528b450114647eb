"""Sinks for people: CSV files, names, the console dashboard, and frames that plots read."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import numbered


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header; for tables of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_names(path: str, names: dict[int, str]) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({int(k): v for k, v in sorted(names.items())}, f, allow_unicode=True)


def dashboard(current: int, names: dict[int, str], probs: DataFrame, transitions: DataFrame, signals: DataFrame) -> str:
    """Text: regime probabilities with bars, where the current regime goes next, and signals. All frames are a few rows."""
    name = lambda k: names.get(k, f"Regime {k}")
    lines = [f"Current regime: {name(current)}", "", "Probabilities"]
    for r in probs.orderBy(F.desc("prob"), "label").collect():
        lines.append(f"  {name(r.label):<40} {r.prob:6.1%} {'#' * int(r.prob * 30)}")
    lines += ["", "Next quarter"]
    for r in transitions.filter(F.col("from_label") == current).orderBy(F.desc("prob"), "to_label").collect():
        lines.append(f"  {name(r.to_label):<40} {r.prob:6.1%}")
    lines += ["", "Assets"]
    for r in signals.orderBy("rank").collect():
        lines.append(f"  {r.rank:>3} {r.asset:<16} {r.median:8.2%} {r.signal}")
    return "\n".join(lines)


def coverage_matrix(df: DataFrame, most: int = 50) -> DataFrame:
    """(series, date, known 0/1) of the first series by name."""
    first = df.select("series").distinct().orderBy("series").limit(most)
    return df.join(first, "series", "left_semi").select("series", "date", F.col("value").isNotNull().cast("int").alias("known"))


def series_sample(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of some series; names that are not there are passed over."""
    return df.filter(F.col("series").isin(names))


def feature_distributions(df: DataFrame, most: int = 20, bins: int = 30) -> DataFrame:
    """``histogram`` of the first series by name that are no second or third derivatives."""
    from .stats import histogram

    plain = df.select("series").distinct().filter(~F.col("series").rlike("_d[23]$"))
    return histogram(df.join(plain.orderBy("series").limit(most), "series", "left_semi"), bins)


def pair_frame(scores: DataFrame, labels: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """(id, PC1, PC2, …, regime) for plots of pairs: at most ``most`` coordinates of ``scores`` (id, x) and the regime's name,
    ``R<label>`` where it has none and ``?`` where a point has no label."""
    width = F.least(F.size("x"), F.lit(most))
    n = scores.select(F.max(width)).first()[0] or 0
    named = labels.join(names, "label", "left").select("id", F.when(F.col("label").isNotNull(), F.coalesce("name", F.concat(F.lit("R"), F.col("label").cast("string")))).alias("regime"))
    return scores.join(named, "id", "left").select("id", *(F.get("x", F.lit(k)).alias(f"PC{k + 1}") for k in range(n)), F.coalesce("regime", F.lit("?")).alias("regime"))


def timeline(labels: DataFrame, days: int = 92, colors: int = 5) -> DataFrame:
    """(date, until, label, color): bars of a quarter's length; noise has no color."""
    known = labels.filter("label is not null")
    return known.select("date", F.date_add("date", days).alias("until"), "label", F.when(F.col("label") >= 0, F.pmod("label", F.lit(colors))).alias("color"))


def scaled_scores(scores: DataFrame) -> DataFrame:
    """Scores of a sweep on one scale: Calinski-Harabasz over its greatest value, Davies-Bouldin turned over."""
    top = scores.agg(F.max("calinski_harabasz").alias("_top"))
    return scores.crossJoin(F.broadcast(top)).select("k", "silhouette", F.try_divide("calinski_harabasz", "_top").alias("calinski_scaled"), F.try_divide(F.lit(1.0), "davies_bouldin").alias("davies_inverse"))


def predicted_vs_actual(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Common dates with both labels; noise is left out."""
    both = predicted.select("date", F.col("label").alias("predicted")).join(actual.select("date", F.col("label").alias("actual")), "date")
    return both.filter("predicted is not null and actual is not null and predicted >= 0 and actual >= 0")


def return_histograms(returns: DataFrame, labels: DataFrame, bins: int = 15, least: int = 3) -> DataFrame:
    """Densities of returns by regime and asset, where there are ``least`` of them."""
    from .stats import histogram

    own = returns.filter("value is not null").join(labels.filter("label is not null"), "date")
    enough = own.groupBy("label", "series").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("label", "series")
    return histogram(own.join(enough, ["label", "series"], "left_semi"), bins, ("label", "series"))


def zip_by_position(a: DataFrame, b: DataFrame, order: str = "date") -> DataFrame:
    """Rows paired by their place in order, cut to the shorter frame; for old results that were aligned so."""
    left = numbered(a, order, name="_i")
    right = numbered(b.withColumnsRenamed({c: f"{c}_2" for c in b.columns}), f"{order}_2", name="_i")
    return left.join(right, "_i").drop("_i")


def validate(df: DataFrame, least_rows: int = 1, columns: list[str] | None = None) -> DataFrame:
    """``df`` if it has rows enough and no missing values in ``columns``; one aggregation, else ValueError."""
    names = df.columns if columns is None else columns
    row = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in names)).first()
    gaps = {c: row[f"_{c}"] for c in names if row[f"_{c}"]}
    if row.n < least_rows or gaps:
        raise ValueError(f"{row.n} rows, missing values {gaps}")
    return df


def top_importances(importances: DataFrame, n: int = 25) -> DataFrame:
    """(rank, feature, importance) of the ``n`` most important features, from 1; ties by name."""
    top = importances.filter("importance is not null").orderBy(F.desc("importance"), "feature").limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).alias("rank"), "feature", "importance")
