"""Returns by regime, ranks, signals, weights and trades."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stoplight, trade
from . import series as S


def quarterly_returns(prices: DataFrame, tie: str | None = None) -> DataFrame:
    """(series, date, value): changes of the last prices of quarters; rows without one are left out."""
    return S.pct_change(S.densify(S.resample_last(prices, tie))).filter("value is not null")


def return_stats(returns: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, asset, median, hit_rate, n) over the returns that are known."""
    both = returns.filter("value is not null").join(labels.filter("label is not null"), "date")
    hit = F.when(F.col("value") > 0, 1.0).otherwise(0.0)
    return both.groupBy("label", F.col("series").alias("asset")).agg(F.median("value").alias("median"), F.avg(hit).alias("hit_rate"), F.count("*").alias("n"))


def return_moments(returns: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, asset, mean, median, std, n): the older table."""
    both = returns.filter("value is not null").join(labels.filter("label is not null"), "date")
    return both.groupBy("label", F.col("series").alias("asset")).agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))


def rank_assets(stats: DataFrame) -> DataFrame:
    """(label, asset, median, rank): 1 is the best of the regime; ties by name."""
    known = stats.filter("median is not null")
    return known.select("label", "asset", "median", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("median"), "asset")).alias("rank"))


def average_ranks(stats: DataFrame) -> DataFrame:
    """Ranks where ties share the mean of their places."""
    w = Window.partitionBy("label")
    first = F.rank().over(w.orderBy(F.desc("median")))
    ties = F.count("*").over(Window.partitionBy("label", "median"))
    return stats.filter("median is not null").select("label", "asset", "median", (first + (ties - 1) / 2).alias("rank"))


def asset_signals(ranked: DataFrame, label: int, green: float = 0.02, yellow: float = 0.0) -> DataFrame:
    """Assets of one regime with a stoplight on their median return."""
    return ranked.filter(F.col("label") == label).select("asset", "median", stoplight(F.col("median"), green, yellow).alias("signal"), "rank")


def simple_portfolio(ranked: DataFrame, label: int, top: int = 3) -> DataFrame:
    """Equal weights of the best assets of one regime; none if the regime is unknown."""
    best = ranked.filter((F.col("label") == label) & (F.col("rank") <= top))
    return best.select("asset", (F.lit(1.0) / F.count("*").over(Window.partitionBy("label"))).alias("weight"))


def blended_portfolio(ranked: DataFrame, probs: DataFrame, top: int = 3) -> DataFrame:
    """Weights of each regime's best assets by the regime's probability, normalised; probs is (label, prob)."""
    likely = probs.filter("prob > 0")
    best = ranked.filter(F.col("rank") <= top)
    share = F.col("prob") / F.count("*").over(Window.partitionBy("label"))
    raw = best.join(likely, "label").withColumn("w", share).groupBy("asset").agg(F.sum("w").alias("w"))
    total = raw.agg(F.sum("w").alias("t"))
    return raw.crossJoin(F.broadcast(total)).select("asset", (F.col("w") / F.col("t")).alias("weight")).filter("weight > 0")


def recommendation(target: DataFrame, current: DataFrame | None = None, threshold: float = 0.05) -> DataFrame:
    """(asset, current_pct, target_pct, delta_pct, signal); an asset that one side lacks has weight 0 there."""
    now = current.withColumnRenamed("weight", "now") if current is not None else target.select("asset", F.lit(0.0).alias("now")).limit(0)
    both = target.withColumnRenamed("weight", "goal").join(now, "asset", "full").select("asset", F.coalesce("now", F.lit(0.0)).alias("now"), F.coalesce("goal", F.lit(0.0)).alias("goal"))
    delta = F.col("goal") - F.col("now")
    pct = lambda x: F.bround(x * 100, 1)
    return both.select("asset", pct(F.col("now")).alias("current_pct"), pct(F.col("goal")).alias("target_pct"), pct(delta).alias("delta_pct"), trade(delta, threshold).alias("signal"))


def signal_counts(trades: DataFrame) -> DataFrame:
    return trades.agg(*(F.count_if(F.col("signal") == s).alias(f"n_{s.lower()}") for s in ("BUY", "SELL", "HOLD")))
