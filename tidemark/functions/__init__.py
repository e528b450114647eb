"""Column expressions: all of them run in the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_end(date: Column) -> Column:
    """Last day of the calendar quarter."""
    return F.last_day(F.add_months(F.trunc(date.cast("date"), "quarter"), 2))


def known(x: Column) -> Column:
    """NaN as null: missing values have one form everywhere."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0 or either is null."""
    return F.try_divide(a, b)


def log_floor(x: Column, floor: float = 1e-9) -> Column:
    """Natural log with a floor; null stays null."""
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(floor))))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


#: Suffixes of scraped values and what becomes of them.
UNIT_SUFFIXES = ("%", " million", " trillion")


def parse_number(raw: Column, kind: Column) -> Column:
    """A scraped value: suffix and commas go, '' is null, percents are fractions."""
    plain = F.trim(raw)
    for suffix in UNIT_SUFFIXES:
        plain = F.replace(plain, F.lit(suffix), F.lit(""))
    number = F.nullif(F.trim(F.replace(plain, F.lit(","), F.lit(""))), F.lit("")).try_cast("double")
    return F.when(kind == "percent", number / 100).otherwise(number)


def parse_date(raw: Column) -> Column:
    """'Jan 31, 2020' as a date; null if it is none."""
    return F.try_to_date(raw, "MMM d, yyyy")


def stoplight(x: Column, green: float, yellow: float) -> Column:
    return F.when(x >= green, "GREEN").when(x >= yellow, "YELLOW").otherwise("RED")


def trade(delta: Column, threshold: float) -> Column:
    return F.when(delta > threshold, "BUY").when(delta < -threshold, "SELL").otherwise("HOLD")


def feature_group(name: Column) -> Column:
    """What a series' name says of it: derivative order, log, source."""
    by_end = F.when(name.endswith("_d1"), "d1").when(name.endswith("_d2"), "d2").when(name.endswith("_d3"), "d3")
    return by_end.when(name.startswith("log_"), "log").when(name.startswith("fred_"), "fred").otherwise("base")
