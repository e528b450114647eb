"""Readers: scraped tables, typed values, labels, fallback files, configuration, fetched series."""
from __future__ import annotations

import functools
import os
import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import known, parse_date, parse_number
from ..operators import series as S


def table_rows(html: Column) -> Column:
    """Cell texts of each table row that has cells: array<array<string>>; header rows hold no ``td``."""
    row = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>|\s+", " ")))
    return F.filter(F.transform(row, cells), lambda r: F.size(r) > 0)


def scrape(pages: DataFrame) -> DataFrame:
    """(series, raw_date, raw_value) from (series, html): the first two cells of each row."""
    rows = pages.select("series", F.explode(table_rows(F.col("html"))).alias("r")).filter(F.size("r") >= 2)
    return rows.select("series", F.col("r")[0].alias("raw_date"), F.col("r")[1].alias("raw_value"))


def typed(raw: DataFrame) -> DataFrame:
    """(series, date, value) by quarter from (series, raw_date, raw_value, kind): kinds num, percent, million, trillion."""
    rows = raw.select("series", parse_date(F.col("raw_date")).alias("date"), parse_number(F.col("raw_value"), F.col("kind")).alias("value"))
    return S.densify(S.resample_last(rows.filter("date is not null and value is not null")))


def long_frame(df: DataFrame, series: str, date: str, value: str) -> DataFrame:
    """Any table as (series, date, value); NaN becomes null here."""
    return df.select(F.col(series).cast("string").alias("series"), F.col(date).cast("date").alias("date"), known(F.col(value)).alias("value"))


def labels(df: DataFrame, category: str = "primary_class", date: str = "date") -> DataFrame:
    """(date, market_code): sorted categories as codes, -1 for none, last of each quarter."""
    from ..operators.regimes import category_codes

    if category not in df.columns:
        raise ValueError(f"column {category!r} is missing")
    rows = category_codes(df.select(F.col(date).cast("date").alias("date"), category), category)
    quarters = S.resample_last(rows.select(F.lit("market_code").alias("series"), "date", F.col("code").cast("double").alias("value")))
    return quarters.select("date", F.col("value").cast("int").alias("market_code"))


def trimmed(df: DataFrame) -> DataFrame:
    """Column names and string cells without white space around them."""
    return df.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip()) if t == "string" else F.col(f"`{c}`").alias(c.strip()) for c, t in df.dtypes))


def parquet_or(spark: SparkSession, path: str, fallback: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where there is none, the fallback's, written there for the next time."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fallback().write.parquet(path)
    return spark.read.parquet(path)


def first_with_rows(*frames: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The first source that has rows; later ones are not asked. A source that raises counts as empty only for OSError."""
    for make in frames:
        try:
            df = make()
        except OSError:
            continue
        if df is not None and df.limit(1).count():
            return df
    return None


def missing(wanted: DataFrame, have: DataFrame, key: str = "series") -> DataFrame:
    """Keys of ``wanted`` that ``have`` lacks."""
    return wanted.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def config(path: str, secrets: dict[str, str] | None = None) -> dict:
    """A YAML file; ``secrets`` names environment variables for dotted places, e.g. {"fred.api_key": "FRED_API_KEY"}."""
    import yaml

    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f) or {}
    for place, variable in (secrets or {}).items():
        at = out
        *path_to, last = place.split(".")
        for k in path_to:
            at = at.setdefault(k, {})
        if variable in os.environ:
            at[last] = os.environ[variable]
    return out


def name_overrides(path: str) -> dict[int, str]:
    """Regime names by number from YAML; other keys are passed over, a missing file has none."""
    import yaml

    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        rows = yaml.safe_load(f) or {}
    return {int(k): str(v) for k, v in rows.items() if str(k).lstrip("-").isdigit() and v}


def register_fetcher(spark: SparkSession, name: str, fetch: Callable[[str], list[tuple]], pause: float = 0.0) -> None:
    """A Python data source ``name``: rows by ``fetch(series)`` for each of option ``series`` (comma-separated).

    Each series is a partition of its own; with a ``pause`` in seconds all are one partition that waits so long between two,
    for sites that limit their rate. A series whose fetch raises OSError has no rows, so one failure does not fail the rest.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.names = [s for s in options.get("series", "").split(",") if s]

        def partitions(self):
            return [InputPartition(self.names)] if pause else [InputPartition([s]) for s in self.names]

        def read(self, partition):
            for k, series in enumerate(partition.value):
                if k:
                    time.sleep(pause)
                try:
                    rows = fetch(series)
                except OSError:
                    continue
                for date, value in rows:
                    yield series, date, value

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "series string, date date, value double"  # unless the reader is given another

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Source)


def retrying(fetch: Callable[[str], list[tuple]], tries: int = 3, wait: float = 1.0) -> Callable[[str], list[tuple]]:
    """``fetch`` asked again after OSError, ``tries`` times in all, each wait twice the one before; the last error is raised."""

    @functools.wraps(fetch)
    def again(series: str) -> list[tuple]:
        for k in range(tries):
            try:
                return fetch(series)
            except OSError:
                if k == tries - 1:
                    raise
                time.sleep(wait * 2**k)
        return []

    return again


def _asked(spark: SparkSession, source: str, names: Iterable[str]) -> DataFrame:
    return spark.read.format(source).option("series", ",".join(names)).load()


def scrape_datasets(spark: SparkSession, datasets: dict[str, str], fetch: Callable[[str], list[tuple]], pause: float = 2.0) -> DataFrame:
    """Quarters of all datasets (name: kind of its values): (date, text) rows by ``fetch(name)``, one after another with a pause."""
    register_fetcher(spark, "scraped_datasets", fetch, pause)
    kinds = spark.createDataFrame(list(datasets.items()), "series string, kind string")
    rows = spark.read.format("scraped_datasets").schema("series string, date string, value string").option("series", ",".join(datasets)).load()
    return typed(rows.select("series", F.col("date").alias("raw_date"), F.col("value").alias("raw_value")).join(kinds, "series"))


def keyed_series(spark: SparkSession, ids: Iterable[str], key: str | None, fetch: Callable[[str, str], list[tuple]], late: Iterable[str] = ()) -> DataFrame:
    """Quarters of series from a service that wants a key: ``fetch(key, id)`` in tasks; ``late`` ones come a quarter later.

    A missing key is an error at once; a series that cannot be fetched has no rows.
    """
    if not key:
        raise ValueError("the service's key is missing: set it in the environment or the configuration")
    register_fetcher(spark, "keyed_series", functools.partial(fetch, key))
    quarters = S.densify(S.resample_last(_asked(spark, "keyed_series", ids)))
    lagged = F.col("series").isin(list(late))
    return quarters.filter(~lagged).unionByName(S.lag(quarters.filter(lagged)))


def close_prices(batch: DataFrame, field: str = "Close") -> DataFrame:
    """Quarter-end prices (series, date, value) of a batch download (time, ticker, field, value).

    Times are text with an offset, which goes: a price belongs to its exchange's own day. Missing prices go too.
    """
    rows = batch.filter((F.col("field") == field) & F.col("value").isNotNull() & ~F.isnan("value"))
    return S.resample_last(rows.select(F.col("ticker").alias("series"), F.to_date(F.substring("time", 1, 10)).alias("date"), "value"))


def price_chain(spark: SparkSession, tickers: Iterable[str], *phases: Callable[[list[str]], DataFrame | None]) -> DataFrame:
    """Prices (series, date, value) by the first phase that has a ticker: each is asked for those still missing, in order.

    A phase that raises OSError has none; when all are asked, tickers may be missing, and with none at all the frame is empty.
    """
    wanted = spark.createDataFrame([(t,) for t in tickers], "series string")
    out = spark.createDataFrame([], "series string, date date, value double")
    for phase in phases:
        still = sorted(r.series for r in missing(wanted, out).collect())  # tickers are few
        if not still:
            break
        try:
            found = phase(still)
        except OSError:
            continue
        if found is not None:
            out = out.unionByName(found.select("series", "date", "value"))
    return out


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The last path by name that fits a glob pattern in any store that Spark reaches; names carry their dates."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return max((f.getPath().toString() for f in found or []), default=None)


def newest_labels(spark: SparkSession, pattern: str, category: str = "primary_class", date: str = "date") -> DataFrame | None:
    """``labels`` of the newest table (Parquet, or CSV by its name); None where there is none or it lacks the category."""
    path = newest(spark, pattern)
    if path is None:
        return None
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return labels(df, category, date) if category in df.columns else None


def label_source(kept, name: str, pattern: str) -> DataFrame | None:
    """(date, label): the newest label file for ``file``, else the checkpoint ``market_code_<name>``; None where it is missing."""
    if name == "file":
        found = newest_labels(kept.spark, pattern)
        return found if found is None else found.withColumnRenamed("market_code", "label")
    try:
        df = kept.load(f"market_code_{name}")
    except FileNotFoundError:
        return None
    value = next(c for c in df.columns if c != "date")
    return df.select("date", F.col(value).cast("int").alias("label"))
