"""Stand-ins for the domain's tables: what the operators read, made from the driver's tables in Spark and in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quarter_end
from ..operators import learn as L
from ..operators import portfolio as P
from ..operators import series as S
from ..session import ensure_checkpoint_dir

QE = "last_day(cast(date_trunc('quarter', {0}) as date) + interval 2 month)"


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def prices(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("tie"))


#: prices by quarter
SQL_QUARTERS = f"""q as (select o_orderpriority as series, {QE.format('o_orderdate')} as date,
 arg_max(o_totalprice, (cast(o_orderdate as date), o_orderkey, o_totalprice)) as value from orders where o_totalprice is not null group by 1, 2)"""
SQL_SPINE = """spine as (select series, last_day(cast(unnest(generate_series(date_trunc('quarter', a), date_trunc('quarter', b), interval 3 month)) as date) + interval 2 month) as date
 from (select series, min(date) as a, max(date) as b from q group by 1)),
dense as (select s.series, s.date, q.value from spine s left join q using (series, date))"""
SQL_RETURNS = f"""{SQL_QUARTERS}, {SQL_SPINE},
held as (select series, date, last_value(value ignore nulls) over (partition by series order by date rows unbounded preceding) as value from dense),
r as (select * from (select series, date, value / lag(value) over (partition by series order by date) - 1 as value from held) where value is not null)"""
#: The regime of a quarter: a fixed rule of its number.
SQL_LABELS = "labels_q as (select date, cast(((year(date) * 4 + quarter(date)) * 7 // 3) % 4 as int) as label from (select distinct date from dense))"
SQL_STATS = f"""{SQL_RETURNS}, {SQL_LABELS},
stats as (select label, series as asset, median(value) as median, avg(case when value > 0 then 1.0 else 0.0 end) as hit_rate, count(*) as n from r join labels_q using (date) group by 1, 2),
ranked as (select label, asset, median, row_number() over (partition by label order by median desc, asset) as rank from stats where median is not null)"""


def quarters(spark: SparkSession, d: str) -> DataFrame:
    return S.resample_last(prices(spark, d), "tie")


def returns(spark: SparkSession, d: str) -> DataFrame:
    return P.quarterly_returns(prices(spark, d), "tie")


def labels(spark: SparkSession, d: str) -> DataFrame:
    dates = S.densify(quarters(spark, d)).select("date").distinct()
    number = F.year("date") * 4 + F.quarter("date")
    return dates.select("date", F.pmod(F.floor(number * 7 / 3), F.lit(4)).cast("int").alias("label"))


def stats(spark: SparkSession, d: str) -> DataFrame:
    return P.return_stats(returns(spark, d), labels(spark, d))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return P.rank_assets(stats(spark, d))


_MACRO = {
    "sp500": "avg(l_extendedprice) / 10",
    "sp500_adj": "avg(l_extendedprice * (1 - l_discount)) / 10",
    "dividend": "avg(l_quantity)",
    "div_yield": "avg(l_discount)",
    "gdp": "sum(l_quantity) / 20",
    "fred_gdp": "sum(l_quantity) / 25",
    "fred_gnp": "sum(l_quantity * (1 - l_tax)) / 25",
    "cpi": "avg(l_tax) * 5000",
    "fred_cpi": "100 + avg(l_tax) * 1000",
    "fred_baa": "avg(l_discount) * 100",
    "fred_aaa": "avg(l_tax) * 100",
}
MACRO = list(_MACRO)
SQL_MACRO = f"macro as (select {QE.format('l_shipdate')} as date, " + ", ".join(f"{v} as {k}" for k, v in _MACRO.items()) + " from lineitem group by 1)"
#: Long form with gaps: every fifth quarter of each series is missing, beginning at its own place.
GAPPED = ["sp500", "dividend", "gdp", "cpi"]
SQL_LONG = f"""{SQL_MACRO},
m as ({' union all '.join(f"select '{s}' as series, date, case when (year(date) * 4 + quarter(date) + {k}) % 5 = 0 then null else {s} end as value from macro" for k, s in enumerate(GAPPED))})"""


def macro(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").withColumn("date", quarter_end(F.col("l_shipdate")))
    return rows.groupBy("date").agg(*(F.expr(v).alias(k) for k, v in _MACRO.items()))


def gapped(spark: SparkSession, d: str) -> DataFrame:
    rows = S.lengthen(macro(spark, d).select("date", *GAPPED))
    number = F.year("date") * 4 + F.quarter("date")
    place = F.array_position(F.array(*map(F.lit, GAPPED)), F.col("series")) - 1
    return rows.withColumn("value", F.when((number + place) % 5 != 0, F.col("value")))


#: Points: all coordinates of all vectors.
SQL_POINTS = "pts as (select vec_id as id, label, embedding::double[] as x from embeddings)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """What models without SQL cluster: scores of all vectors on their first five principal axes."""
    ensure_checkpoint_dir(spark)
    return L.pca(points(spark, d), 5).checkpoint()
