"""Descriptive statistics of long frames, and what plots need."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import numbered, placed_by


def coverage(df: DataFrame) -> DataFrame:
    """(series, n_valid, n_total, pct)."""
    return df.groupBy("series").agg(F.count("value").alias("n_valid"), F.count("*").alias("n_total"), (F.avg(F.col("value").isNotNull().cast("int")) * 100).alias("pct"))


def quantiles(df: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(…, q): exact quantiles of ``value`` in each group, between the nearest two values as usual; groups without one are left out.

    Distinct values are counted and put in one order by ranges, so a large group lies over many partitions and copies are one
    row; no task holds the values of a group.
    """
    known = df.filter("value is not null").select(*by, F.col("value").cast("double").alias("value"))
    rows = placed_by(known.groupBy(*by, "value").agg(F.count("*").alias("n")), "n", *by, "value")
    groups = rows.groupBy(*by).agg(F.min("_before").alias("_start"), F.sum("n").alias("_total"))
    at = F.array(*(F.lit(float(q)) * (F.col("_total") - 1) for q in shares))
    wanted = groups.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by)), "_start", F.posexplode(at).alias("_which", "_at"))
    low, high = F.col("_start") + F.floor("_at"), F.col("_start") + F.ceil("_at")
    inside = lambda place: (F.col("_before") <= place) & (place < F.col("_before") + F.col("n"))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    met = rows.join(wanted, [*same, inside(low) | inside(high)])
    part = F.col("_at") - F.floor("_at")
    ends = met.groupBy(*by, "_which", "_at").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    each = ends.select(*by, "_which", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("v"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_which", "v"))), lambda r: r["v"]).alias("q"))


def describe(df: DataFrame) -> DataFrame:
    """(series, n, mean, std, min, q25, q50, q75, max)."""
    rows = df.groupBy("series").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(df, ["series"], [0.25, 0.5, 0.75]).withColumnRenamed("series", "_series")
    rows = rows.join(q, F.col("series").eqNullSafe(F.col("_series")), "left")
    return rows.select("series", "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def top_variance(df: DataFrame, n: int) -> DataFrame:
    return df.groupBy("series").agg(F.var_samp("value").alias("variance")).orderBy(F.desc("variance"), "series").limit(n)


def correlations(df: DataFrame, n: int = 40) -> DataFrame:
    """(a, b, r, n): Pearson correlation of the ``n`` most varied series over the dates that both know.

    One join on the date: n values a date meet each other, and n is bounded.
    """
    own = df.filter("value is not null").join(top_variance(df, n).select("series"), "series", "left_semi")
    a, b = own.select("date", F.col("series").alias("a"), F.col("value").alias("x")), own.select("date", F.col("series").alias("b"), F.col("value").alias("y"))
    return a.join(b, "date").groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def histogram(df: DataFrame, bins: int = 30, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """(…, bin, low, n, density): equal bins from least to greatest value, the last closed; bins from 1."""
    known = df.filter("value is not null")
    span = known.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total"))
    wide = F.col("hi") - F.col("lo")
    k = F.when(wide == 0, 1).otherwise(F.least(F.floor(F.try_divide((F.col("value") - F.col("lo")) * bins, wide)) + 1, F.lit(bins))).cast("int")
    rows = known.join(span, list(by)).withColumn("bin", k).groupBy(*by, "bin", "lo", "hi", "total").agg(F.count("*").alias("n"))
    step = (F.col("hi") - F.col("lo")) / bins
    return rows.select(*by, "bin", (F.col("lo") + (F.col("bin") - 1) * step).alias("low"), "n", F.try_divide(F.col("n"), F.col("total") * step).alias("density"))


def box_stats(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, series, q25, q50, q75, low, high): whiskers reach the furthest value within 1.5 quartile ranges."""
    own = features.filter("value is not null").join(labels.filter("label is not null"), "date")
    q = quantiles(own, ["label", "series"], [0.25, 0.5, 0.75])
    q = q.select("label", "series", *(F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = own.join(q, ["label", "series"]).filter((F.col("value") >= F.col("q25") - reach) & (F.col("value") <= F.col("q75") + reach))
    return inside.groupBy("label", "series", "q25", "q50", "q75").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share)."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def pages(df: DataFrame, per_page: int = 8) -> DataFrame:
    """Series in name order, so many a page."""
    ids = df.select("series").distinct()
    return numbered(ids, "series").select("series", F.floor(F.col("_rn") / per_page).cast("int").alias("page"))
