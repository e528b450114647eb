"""Ratios, logs, selection and the whole feature plan."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import log_floor, ratio
from . import series as S

#: Derived column -> (numerator, denominator).
RATIOS = {
    "div_yield2": ("dividend", "sp500"),
    "price_div": ("sp500", "dividend"),
    "price_gdp": ("sp500", "gdp"),
    "price_gdp2": ("sp500", "fred_gdp"),
    "price_gnp2": ("sp500", "fred_gnp"),
    "real_price2": ("sp500", "cpi"),
    "real_price3": ("sp500", "fred_cpi"),
    "real_price_gdp2": ("sp500_adj", "gdp"),
}


def cross_ratios(wide: DataFrame) -> DataFrame:
    """Eight ratios and two spreads of yields; yields of bonds are in percent points, the dividend yield is a fraction."""
    c = F.col
    made = {name: ratio(c(a), c(b)) for name, (a, b) in RATIOS.items()}
    made["div_minus_baa"] = c("div_yield") - c("fred_baa") / 100
    made["credit_spread"] = (c("fred_baa") - c("fred_aaa")) / 100
    return wide.withColumns(made)


def log_transforms(wide: DataFrame, columns: list[str], floor: float | None = 1e-9) -> DataFrame:
    """log_<c> for those of ``columns`` that exist. Without a floor, values of 0 and below have no log."""
    own = [c for c in columns if c in wide.columns]
    log = (lambda x: log_floor(x, floor)) if floor else (lambda x: F.when(x > 0, F.ln(x)))
    return wide.withColumns({f"log_{c}": log(F.col(c)) for c in own})


def select_features(wide: DataFrame, names: list[str]) -> DataFrame:
    """Those of ``names`` that exist, in that order, then the label if there is one."""
    own = [c for c in names if c in wide.columns]
    return wide.select("date", *own, *(["market_code"] if "market_code" in wide.columns and "market_code" not in own else []))


def drop_columns_with_nulls(wide: DataFrame) -> DataFrame:
    """Columns that are whole: one pass counts, the driver sees one row."""
    counts = wide.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in wide.columns)).first()
    return wide.select(*(c for c in wide.columns if not counts[c]))


def engineer(wide: DataFrame, logs: list[str], initial: list[str], final: list[str], causal: bool = False, strict: bool = False, window: int = 5) -> DataFrame:
    """Ratios, logs, selection, gap fill, derivatives, selection: a long frame (series, date, value).

    The label, if any, rides along: derivatives leave out rows without it. In ``strict`` mode gaps hold the last known value.
    """
    chosen = select_features(log_transforms(cross_ratios(wide), logs), initial)
    label = "market_code" in chosen.columns
    rows = S.lengthen(chosen.drop("market_code"))
    if label:
        rows = rows.join(chosen.select("date", "market_code"), "date").select("series", "date", "value", "market_code")
    if strict:
        w = S.Window.partitionBy("series").orderBy("date").rowsBetween(S.Window.unboundedPreceding, 0)
        filled = rows.withColumn("value", F.last("value", ignorenulls=True).over(w))
    else:
        filled = S.gap_fill(rows, window)
    both = S.with_derivatives(filled, window, causal, strict)
    parts = F.array(*(F.struct(F.concat("series", F.lit(tail)).alias("series"), F.col(c).alias("value")) for tail, c in (("", "value"), ("_d1", "d1"), ("_d2", "d2"), ("_d3", "d3"))))
    return both.select("date", F.inline(parts)).filter(F.col("series").isin(final)).select("series", "date", "value")
