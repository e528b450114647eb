"""Resampling, lags, changes, smoothing, derivatives and gap filling of long series.

All windows of one frame share ``partitionBy(series).orderBy(date)``, so a chain of them costs one shuffle and one sort.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quarter_end, ratio

KEYS = ("series", "date")


def _by_series(df: DataFrame) -> Window:
    return Window.partitionBy("series").orderBy("date")


def resample_last(df: DataFrame, tie: str | None = None) -> DataFrame:
    """Last known value of each series in each calendar quarter, dated by the quarter's end.

    Ties on a date go to the largest ``tie``, then to the largest value. One partial aggregation, then one shuffle.
    """
    known = df.filter("value is not null")
    order = F.struct("date", *([tie] if tie else []), "value")
    return known.groupBy("series", quarter_end(F.col("date")).alias("q")).agg(F.max_by("value", order).alias("value")).select("series", F.col("q").alias("date"), "value")


def densify(df: DataFrame) -> DataFrame:
    """Every quarter between a series' first and last; those that are missing have a null value."""
    span = df.groupBy("series").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    step = F.sequence(F.trunc("a", "quarter"), F.trunc("b", "quarter"), F.expr("interval 3 months"))
    spine = span.select("series", F.explode(step).alias("d")).select("series", quarter_end(F.col("d")).alias("date"))
    return spine.join(df, list(KEYS), "left")


def lag(df: DataFrame, n: int = 1) -> DataFrame:
    """Values shifted by ``n`` rows (publication lag); negative ``n`` leads."""
    return df.withColumn("value", F.lag("value", n).over(_by_series(df)) if n >= 0 else F.lead("value", -n).over(_by_series(df)))


def pct_change(df: DataFrame, pad: bool = True) -> DataFrame:
    """Relative change against the row before. ``pad``: a missing value counts as the last known one."""
    w = _by_series(df)
    held = df.withColumn("value", F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))) if pad else df
    return held.withColumn("value", ratio(F.col("value"), F.lag("value").over(w)) - 1)


def bounds(window: int, center: bool) -> tuple[int, int]:
    """Rows before and after that a window of so many rows takes in."""
    return (-(window // 2), (window - 1) // 2) if center else (-(window - 1), 0)


def rolling_mean(df: DataFrame, window: int = 5, center: bool = True, column: str = "value", to: str | None = None) -> DataFrame:
    """Mean of the known values among ``window`` rows, one at least."""
    return df.withColumn(to or column, F.avg(column).over(_by_series(df).rowsBetween(*bounds(window, center))))


def _gradient(column: str, day: str, w: Window) -> Column:
    """Second-order differences on an uneven axis, first-order at the ends; null for a single row."""
    f, x = F.col(column), F.col(day)
    f0, f1, x0, x1 = F.lag(f).over(w), F.lead(f).over(w), F.lag(x).over(w), F.lead(x).over(w)
    hs, hd = (x - x0).cast("double"), (x1 - x).cast("double")
    inner = (hs * hs * f1 + (hd * hd - hs * hs) * f - hd * hd * f0) / (hs * hd * (hd + hs))
    return F.when(x0.isNull() & x1.isNull(), None).when(x0.isNull(), (f1 - f) / hd).when(x1.isNull(), (f - f0) / hs).otherwise(inner)


def gradient(df: DataFrame, column: str = "value", to: str = "gradient", backward: bool = False) -> DataFrame:
    """Change of ``column`` per day. ``backward`` looks at the row before alone, never ahead."""
    w = _by_series(df)
    days = df.withColumn("_day", F.datediff("date", F.lit("1950-01-01").cast("date")))
    change = (F.col(column) - F.lag(column).over(w)) / (F.col("_day") - F.lag("_day").over(w)) if backward else _gradient(column, "_day", w)
    return days.withColumn(to, change).drop("_day")


def derivatives(df: DataFrame, window: int = 5, causal: bool = False, strict: bool = False) -> DataFrame:
    """Known rows of ``df`` with d1, d2, d3: smoothed gradients of the smoothed value, three times over.

    ``causal`` smooths over rows up to the present one; gradients still look one row ahead each. ``strict`` takes backward
    differences, so nothing of a later row is used. If ``df`` has a column market_code, rows where it is null are left out.
    """
    rows = df.filter("value is not null")
    if "market_code" in df.columns:
        rows = rows.filter("market_code is not null")
    center = not (causal or strict)
    out = rolling_mean(rows, window, center, "value", "_s")
    for k in (1, 2, 3):
        out = gradient(out, "_s", "_g", strict)
        out = rolling_mean(out, window, center, "_g", f"d{k}").withColumn("_s", F.col(f"d{k}"))
    return out.drop("_s", "_g")


def with_derivatives(df: DataFrame, window: int = 5, causal: bool = False, strict: bool = False) -> DataFrame:
    """``df`` with d1, d2, d3, null on rows that have none."""
    own = derivatives(df, window, causal, strict).select(*KEYS, "d1", "d2", "d3")
    return df.join(own, list(KEYS), "left")


def gap_boundaries(df: DataFrame, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """For each row the nearest known row before (``b_``) and after (``a_``): date and ``columns``."""
    w = _by_series(df)
    row = F.when(F.col("value").isNotNull(), F.struct("date", *columns))
    before = F.last(row, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(row, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = df.withColumns({"_b": before, "_a": after})
    return both.select(*df.columns, *(F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in "ba" for c in ("date", *columns)))


def _hermite() -> Column:
    """Septic Bernstein polynomial with value and three derivatives given at both ends."""
    day = lambda c: F.datediff(c, F.lit("1950-01-01").cast("date")).cast("double")
    t0, t1, t = day(F.col("b_date")), day(F.col("a_date")), day(F.col("date"))
    h = t1 - t0
    s = F.try_divide(t - t0, h)
    y0, p1, p2, p3 = (F.col(f"b_{c}") for c in ("value", "d1", "d2", "d3"))
    y1, q1, q2, q3 = (F.col(f"a_{c}") for c in ("value", "d1", "d2", "d3"))
    c0, c7 = y0, y1
    c1, c6 = c0 + h * p1 / 7, c7 - h * q1 / 7
    c2, c5 = 2 * c1 - c0 + h * h * p2 / 42, 2 * c6 - c7 + h * h * q2 / 42
    c3, c4 = 3 * c2 - 3 * c1 + c0 + h * h * h * p3 / 210, 3 * c5 - 3 * c6 + c7 - h * h * h * q3 / 210
    total = F.lit(0.0)
    for k, (c, n) in enumerate(zip((c0, c1, c2, c3, c4, c5, c6, c7), (1, 7, 21, 35, 35, 21, 7, 1))):
        total = total + n * c * F.pow(s, F.lit(k)) * F.pow(1 - s, F.lit(7 - k))
    return total


def _taylor(side: str) -> Column:
    dt = F.datediff("date", f"{side}_date").cast("double")
    y, d1, d2, d3 = (F.col(f"{side}_{c}") for c in ("value", "d1", "d2", "d3"))
    return y + d1 * dt + d2 * dt * dt / 2 + d3 * dt * dt * dt / 6


def gap_fill(df: DataFrame, window: int = 5) -> DataFrame:
    """Missing values filled: between known rows by a polynomial that meets both sides' values and derivatives, before the
    first and after the last by the cubic of the nearest. A series without known values stays as it is."""
    around = gap_boundaries(with_derivatives(df, window), ("value", "d1", "d2", "d3"))
    fill = F.when(F.col("b_date").isNull(), _taylor("a")).when(F.col("a_date").isNull(), _taylor("b")).otherwise(_hermite())
    return around.withColumn("value", F.coalesce("value", fill)).select(*df.columns)


def trim_tail(wide: DataFrame, columns: list[str] | None = None, enabled: bool = True) -> DataFrame:
    """Rows up to the last that is complete in ``columns``; all rows if none is. One aggregate row is joined to the frame."""
    if not enabled:
        return wide
    columns = [c for c in wide.columns if c not in ("date", "market_code")] if columns is None else columns
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    last = wide.agg(F.max(F.when(whole, F.col("date"))).alias("_last"))
    return wide.crossJoin(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col("date") <= F.col("_last"))).drop("_last")


def widen(df: DataFrame, names: list[str]) -> DataFrame:
    """Outer alignment of series on dates: one pivot with the names given, not a join for each."""
    return df.filter(F.col("series").isin(names)).groupBy("date").pivot("series", names).agg(F.first("value", ignorenulls=True))


def lengthen(wide: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = [c for c in wide.columns if c != "date"] if names is None else names
    return wide.unpivot(["date"], names, "series", "value").select("series", "date", "value")


def proxy_returns(wide: DataFrame, prices: list[str], rates: list[str]) -> DataFrame:
    """Relative changes of price columns beside the levels of rate columns, without rows where all are missing and without
    the first of the rest. Wide frames of quarters are small: one row a quarter."""
    names = [c for c in (*prices, *rates) if c in wide.columns]
    rows = lengthen(wide.select("date", *(F.col(c).cast("double").alias(c) for c in names)))
    moved = pct_change(rows.filter(F.col("series").isin(prices))).unionByName(rows.filter(F.col("series").isin(rates)))
    out = widen(moved, names).dropna("all", subset=names)
    first = out.agg(F.min("date").alias("_first"))
    return out.crossJoin(F.broadcast(first)).filter("date > _first").drop("_first")
