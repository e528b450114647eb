"""Profiles, names, transitions and canonical numbers of regimes. Labels are (date, label); features are long."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How each statistic of a profile is formed; the deviation is that of a sample, the median exact.
STATS = {"mean": F.avg, "median": F.median, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}


def align(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Long features with the label of their date; dates without one are left out."""
    return features.join(labels.filter("label is not null"), "date")


def profiles(features: DataFrame, labels: DataFrame, stats: tuple[str, ...] = ("mean", "median", "std")) -> DataFrame:
    """(label, series, stat, value): partial aggregation by label and series; one row alone has no deviation."""
    own = align(features, labels).groupBy("label", "series").agg(*(STATS[s]("value").cast("double").alias(s) for s in stats))
    return own.unpivot(["label", "series"], list(stats), "stat", "value")


#: Fixed values: (feature, name when high, name when low, relative distance from the overall median), in order of precedence.
NAME_RULES = (
    ("us_infl", "High Inflation", "Low Inflation", 0.20),
    ("log_cpi_d1", "Rising CPI", "Falling CPI", 0.10),
    ("log_fred_cpi_d1", "Rising CPI", "Falling CPI", 0.10),
    ("gdp_growth", "Strong Growth", "Weak/Neg Growth", 0.20),
    ("real_gdp_growth", "Strong Real Growth", "Weak Real Growth", 0.20),
    ("log_fred_gdp_d1", "GDP Expanding", "GDP Contracting", 0.10),
    ("10yr_ustreas", "High Rates", "Low Rates", 0.20),
    ("fred_gs10", "High Rates", "Low Rates", 0.20),
    ("fred_tb3ms", "Tight Short Rates", "Easy Short Rates", 0.20),
    ("10yr_ustreas_d1", "Rates Rising", "Rates Falling", 0.10),
    ("credit_spread", "Wide Credit Spread", "Tight Credit Spread", 0.20),
    ("div_minus_baa", "High Div Premium", "Low Div Premium", 0.10),
    ("sp500_pe", "High Valuations", "Low Valuations", 0.20),
    ("log_cape_shiller_d1", "Valuations Rising", "Valuations Falling", 0.10),
    ("log_earn_d1", "Earnings Growing", "Earnings Declining", 0.10),
    ("log_div_yield_d1", "Yield Rising", "Yield Falling", 0.10),
)


def suggest_names(features: DataFrame, labels: DataFrame, rules: tuple = NAME_RULES, most: int = 3) -> DataFrame:
    """(label, name): up to ``most`` tags of features whose median in the regime lies off the overall median.

    High is tested first, features with an overall median of 0 are passed over, tags keep the rules' order, a regime without
    tags is ``Regime <label>``.
    """
    spark = features.sparkSession
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "rank int, series string, high string, low string, off double")
    own = align(features.join(table.select("series"), "series", "left_semi"), labels)
    overall = own.groupBy("series").agg(F.median("value").alias("g"))
    inside = own.groupBy("label", "series").agg(F.median("value").alias("m"))
    both = inside.join(overall.filter("g <> 0"), "series").join(table, "series")
    tag = F.when(F.col("m") > F.col("g") * (1 + F.col("off")), F.col("high")).when(F.col("m") < F.col("g") * (1 - F.col("off")), F.col("low"))
    tagged = both.withColumn("tag", tag).filter("tag is not null").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("tags"))
    words = F.slice(F.array_distinct(F.transform("tags", lambda x: x["tag"])), 1, most)
    every = labels.filter("label is not null").select("label").distinct()
    return every.join(tagged, "label", "left").select("label", F.coalesce(F.array_join(words, " / "), default_name()).alias("name"))


def default_name(label: str = "label") -> Column:
    return F.concat(F.lit("Regime "), F.col(label).cast("string"))


def threshold_names(profile: DataFrame) -> DataFrame:
    """(label, name) from absolute thresholds on columns infl, gdp, spread, sp_d1; a later regime of a name taken adds its number."""
    infl, gdp, spread, d1 = (F.col(c) for c in ("infl", "gdp", "spread", "sp_d1"))
    name = (
        F.when((infl > 0.04) & (gdp < 0.02), "Stagflation")
        .when((gdp > 0.03) & (d1 > 0), "Growth Boom")
        .when((spread > 0.015) & (d1 < 0), "Credit Crisis")
        .when((infl < 0.03) & (gdp > 0.01) & (gdp < 0.04), "Goldilocks")
        .otherwise("Transition")
    )
    again = F.row_number().over(Window.partitionBy("name").orderBy("label")) > 1
    unique = F.when(again, F.concat("name", F.lit(" ("), F.col("label").cast("string"), F.lit(")"))).otherwise(F.col("name"))
    return profile.withColumn("name", name).select("label", unique.alias("name"))


def override_names(auto: DataFrame, own: DataFrame) -> DataFrame:
    """Given names win over suggested ones; (label, name) each."""
    right = own.withColumnRenamed("name", "given")
    return auto.join(right, "label", "full").select("label", F.coalesce("given", "name").alias("name"))


def _in_order(labels: DataFrame) -> Window:
    # One label a date: a label table is as long as there are quarters.
    return Window.orderBy("date")


def _grid(known: DataFrame) -> DataFrame:
    ids = known.select("label").distinct()
    return ids.select(F.col("label").alias("from_label")).crossJoin(ids.select(F.col("label").alias("to_label")))


def transition_matrix(labels: DataFrame) -> DataFrame:
    """(from_label, to_label, n, prob) on the dense grid; the row of a label that has no successor is all 0."""
    known = labels.filter("label is not null")
    steps = known.select(F.col("label").alias("from_label"), F.lead("label").over(_in_order(known)).alias("to_label")).filter("to_label is not null")
    counts = steps.groupBy("from_label", "to_label").agg(F.count("*").alias("n"))
    dense = _grid(known).join(counts, ["from_label", "to_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(Window.partitionBy("from_label"))
    return dense.withColumn("prob", F.col("n") / F.when(total == 0, 1).otherwise(total))


def forward_probabilities(labels: DataFrame, horizon: int) -> DataFrame:
    """(from_label, to_label, prob): how often a label is seen once at least in the next ``horizon`` rows, over rows that have so many."""
    w = _in_order(labels)
    known = labels.filter("label is not null")
    ahead = known.select("label", F.collect_set("label").over(w.rowsBetween(1, horizon)).alias("seen"), F.lead("label", horizon).over(w).alias("last")).filter("last is not null")
    ids = known.select(F.col("label").alias("to_label")).distinct()
    both = ahead.crossJoin(ids)
    hit = F.expr("case when array_contains(seen, to_label) then 1.0D else 0.0D end")
    return both.groupBy(F.col("label").alias("from_label"), "to_label").agg(F.avg(hit).alias("prob"))


def canonical(points: DataFrame, by: str = "pc1") -> DataFrame:
    """(…, label): labels renumbered from 0 by the mean of ``by``; noise (-1) stays. Ties go by the old number."""
    means = points.filter("label >= 0").groupBy("label").agg(F.avg(by).alias("m"))
    ranked = means.select("label", (F.row_number().over(Window.orderBy("m", "label")) - 1).alias("_new"))
    return points.join(ranked, "label", "left").withColumn("label", F.coalesce("_new", "label").cast("int")).drop("_new")


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """``code``: rank of the category in sorted order from 0, -1 for null. Categories are few and ranked apart from the rows."""
    ids = df.filter(F.col(column).isNotNull()).select(column).distinct()
    ranked = ids.withColumn("code", (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(ranked, column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))
