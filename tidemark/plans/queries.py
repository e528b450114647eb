"""One query for each operator, with its SQL where SQL can say it. Doubles are rounded alike on both sides."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import sources
from ..operators import density as D
from ..operators import features as X
from ..operators import hierarchy as H
from ..operators import learn as L
from ..operators import metrics as M
from ..operators import portfolio as P
from ..operators import regimes as R
from ..operators import reports as V
from ..operators import series as S
from ..operators import stats as T
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded; -0.0 becomes 0.0."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


# Series.


@query(f"with {I.SQL_QUARTERS} select series, date, round(value, 6) as value from q")
def qe_resample_last(s, d):
    return rounded(I.quarters(s, d))


@query(f"with {I.SQL_QUARTERS}, {I.SQL_SPINE} select series, date, round(value, 6) as value from dense")
def qe_densify(s, d):
    return rounded(S.densify(I.quarters(s, d)))


@query(f"with {I.SQL_QUARTERS}, {I.SQL_SPINE} select series, date, round(lag(value) over (partition by series order by date), 6) as value from dense")
def publication_lag(s, d):
    return rounded(S.lag(S.densify(I.quarters(s, d))))


@query(f"with {I.SQL_QUARTERS}, {I.SQL_SPINE} select * from (select series, date, round(lead(value, 2) over (partition by series order by date), 6) as value from dense) where value is not null")
def lead_labels(s, d):
    return rounded(S.lag(S.densify(I.quarters(s, d)), -2).filter("value is not null"))


@query(f"with {I.SQL_LONG}, held as (select series, date, last_value(value ignore nulls) over (partition by series order by date rows unbounded preceding) as value from m) select series, date, round(value / lag(value) over (partition by series order by date) - 1, 6) as value from held")
def pct_change_padded(s, d):
    return rounded(S.pct_change(I.gapped(s, d)))


@query(f"with {I.SQL_LONG} select series, date, round(value / lag(value) over (partition by series order by date) - 1, 6) as value from m")
def pct_change_plain(s, d):
    return rounded(S.pct_change(I.gapped(s, d), pad=False))


@query(f"with {I.SQL_RETURNS} select series, date, round(value, 6) as value from r")
def quarterly_returns(s, d):
    return rounded(I.returns(s, d))


@query(
    f"""with {I.SQL_MACRO}, w as (select date, sp500, sp500_adj, fred_baa, (fred_baa - fred_aaa) / 100 as credit_spread from macro),
 p as (select date, sp500 / lag(sp500) over (order by date) - 1 as sp500, sp500_adj / lag(sp500_adj) over (order by date) - 1 as sp500_adj, credit_spread from w)
 select date, round(sp500, 6) as sp500, round(sp500_adj, 6) as sp500_adj, round(credit_spread, 6) as credit_spread from p where date > (select min(date) from p)"""
)
def proxy_returns(s, d):
    return rounded(S.proxy_returns(X.cross_ratios(I.macro(s, d)), ["sp500", "sp500_adj"], ["credit_spread"]))


def _rolling(center: bool, w: int) -> str:
    a, b = S.bounds(w, center)
    return f"avg({{0}}) over (partition by series order by date rows between {-a} preceding and {b} following)"


for _name, _center, _w in (("rolling_mean_centered", True, 5), ("rolling_mean_centered_even", True, 4), ("rolling_mean_trailing", False, 5)):
    QUERIES[_name] = lambda s, d, c=_center, w=_w: rounded(S.rolling_mean(I.gapped(s, d), w, c))
    ORACLES[_name] = f"with {I.SQL_LONG} select series, date, round({_rolling(_center, _w).format('value')}, 6) as value from m"


def _sql_gradient(src: str, column: str, to: str, name: str, keep: str, backward: bool = False) -> str:
    """A CTE ``name`` of ``src`` with the gradient of ``column``."""
    if backward:
        g = "(f - f0) / (x - x0)"
    else:
        g = """case when x0 is null and x1 is null then null when x0 is null then (f1 - f) / (x1 - x) when x1 is null then (f - f0) / (x - x0)
 else (pow(x - x0, 2) * f1 + (pow(x1 - x, 2) - pow(x - x0, 2)) * f - pow(x1 - x, 2) * f0) / ((x - x0) * (x1 - x) * (x1 - x0)) end"""
    return f"""{name} as (select {keep}, {g} as {to} from (select {keep}, {column} as f, date_diff('day', date '1950-01-01', date)::double as x,
 lag({column}) over w as f0, lead({column}) over w as f1, lag(date_diff('day', date '1950-01-01', date)::double) over w as x0,
 lead(date_diff('day', date '1950-01-01', date)::double) over w as x1 from {src} window w as (partition by series order by date)))"""


def _sql_derivatives(src: str, center: bool, window: int = 5, backward: bool = False, tag: str = "") -> str:
    """CTEs up to ``der{tag}``: series, date, value, d1, d2, d3 of the known rows of ``src``."""
    roll = _rolling(center, window)
    t = tag
    return f"""known{t} as (select * from {src} where value is not null), s0{t} as (select series, date, value, {roll.format('value')} as s from known{t}),
{_sql_gradient(f's0{t}', 's', 'g', f'g1{t}', 'series, date, value', backward)}, s1{t} as (select series, date, value, {roll.format('g')} as d1 from g1{t}),
{_sql_gradient(f's1{t}', 'd1', 'g', f'g2{t}', 'series, date, value, d1', backward)}, s2{t} as (select series, date, value, d1, {roll.format('g')} as d2 from g2{t}),
{_sql_gradient(f's2{t}', 'd2', 'g', f'g3{t}', 'series, date, value, d1, d2', backward)}, der{t} as (select series, date, value, d1, d2, {roll.format('g')} as d3 from g3{t})"""


@query(f"with {I.SQL_LONG}, k as (select * from m where value is not null), {_sql_gradient('k', 'value', 'gradient', 'g', 'series, date, value')} select series, date, round(value, 4) as value, round(gradient, 4) as gradient from g")
def gradient_uneven(s, d):
    return rounded(S.gradient(I.gapped(s, d).filter("value is not null")), 4)


#: Derivatives are told in quarters, not days, so that rounding leaves them digits.
_PER_QUARTER = {"d1": 91.0, "d2": 91.0**2, "d3": 91.0**3}


def _scaled(df: DataFrame) -> DataFrame:
    return rounded(df.withColumns({c: F.col(c) * k for c, k in _PER_QUARTER.items()}), 4)


_SQL_SCALED = ", ".join(f"round({c} * {k}, 4) as {c}" for c, k in _PER_QUARTER.items())

for _name, _center, _strict in (("derivatives_centered", True, False), ("derivatives_causal", False, False), ("derivatives_strict", False, True)):
    QUERIES[_name] = lambda s, d, c=_center, b=_strict: _scaled(S.derivatives(I.gapped(s, d), causal=not c, strict=b))
    ORACLES[_name] = f"with {I.SQL_LONG}, {_sql_derivatives('m', _center, 5, _strict)} select series, date, round(value, 4) as value, {_SQL_SCALED} from der"


@query(f"with {I.SQL_LONG}, {_sql_derivatives('m', True)} select m.series, m.date, round(m.value, 4) as value, {_SQL_SCALED} from m left join der using (series, date)")
def derivatives_on_all_dates(s, d):
    return _scaled(S.with_derivatives(I.gapped(s, d)))


@query(
    f"""with {I.SQL_LONG} select series, date, max(case when value is not null then date end) over (partition by series order by date rows unbounded preceding) as b_date,
 round(last_value(value ignore nulls) over (partition by series order by date rows unbounded preceding), 4) as b_value,
 min(case when value is not null then date end) over (partition by series order by date rows between current row and unbounded following) as a_date,
 round(first_value(value ignore nulls) over (partition by series order by date rows between current row and unbounded following), 4) as a_value from m"""
)
def gap_boundaries(s, d):
    return rounded(S.gap_boundaries(I.gapped(s, d)).drop("value"), 4)


def _sql_fill(src: str = "m", tag: str = "f") -> str:
    """CTEs up to ``filled``: series, date, value."""
    row = "case when m0.value is not null then {'date': m0.date, 'value': m0.value, 'd1': d1, 'd2': d2, 'd3': d3} end"
    taylor = lambda p: f"({p}.value + {p}.d1 * t + {p}.d2 * t * t / 2 + {p}.d3 * t * t * t / 6)".replace(" t ", f" date_diff('day', {p}.date, date) ").replace(" t)", f" date_diff('day', {p}.date, date))")
    c = {0: "b.value", 7: "a.value"}
    c[1], c[6] = "(b.value + h * b.d1 / 7)", "(a.value - h * a.d1 / 7)"
    c[2], c[5] = f"(2 * {c[1]} - b.value + h * h * b.d2 / 42)", f"(2 * {c[6]} - a.value + h * h * a.d2 / 42)"
    c[3], c[4] = f"(3 * {c[2]} - 3 * {c[1]} + b.value + h * h * h * b.d3 / 210)", f"(3 * {c[5]} - 3 * {c[6]} + a.value - h * h * h * a.d3 / 210)"
    poly = " + ".join(f"{n} * {c[k]} * pow(s, {k}) * pow(1 - s, {7 - k})" for k, n in enumerate((1, 7, 21, 35, 35, 21, 7, 1)))
    return f"""{_sql_derivatives(src, True, 5, False, tag)}, j{tag} as (select m0.series, m0.date, m0.value, {row} as r from {src} m0 left join der{tag} using (series, date)),
ab{tag} as (select series, date, value, last_value(r ignore nulls) over (partition by series order by date rows unbounded preceding) as b,
 first_value(r ignore nulls) over (partition by series order by date rows between current row and unbounded following) as a from j{tag}),
hs{tag} as (select *, date_diff('day', b.date, a.date)::double as h, date_diff('day', b.date, date)::double / nullif(date_diff('day', b.date, a.date), 0) as s from ab{tag}),
filled as (select series, date, coalesce(value, case when b is null then {taylor('a')} when a is null then {taylor('b')} else {poly} end) as value from hs{tag})"""


@query(f"with {I.SQL_LONG}, {_sql_fill()} select series, date, round(value, 3) as value from filled")
def gap_fill(s, d):
    return rounded(S.gap_fill(I.gapped(s, d)), 3)


_FINAL = ["sp500", "sp500_d1", "dividend_d2", "gdp_d1", "cpi", "cpi_d1"]


@query(
    f"""with {I.SQL_LONG}, {_sql_fill()}, {_sql_derivatives('filled', False, 5, False, 'e')},
 e as (select series, date, value from filled union all select series || '_d1', date, d1 * 91 from dere union all select series || '_d2', date, d2 * 8281 from dere)
 select series, date, round(value, 3) as value from e where series in ({', '.join(repr(x) for x in _FINAL)})"""
)
def engineer_features(s, d):
    wide = S.widen(I.gapped(s, d), I.GAPPED).join(I.macro(s, d).drop(*I.GAPPED), "date")
    out = X.engineer(wide, ["sp500"], I.GAPPED, _FINAL, causal=True)
    scale = F.when(F.col("series").endswith("_d1"), 91.0).when(F.col("series").endswith("_d2"), 8281.0).otherwise(1.0)
    return rounded(out.withColumn("value", F.col("value") * scale), 3)


@query(
    f"""with {I.SQL_MACRO} select date, round(dividend / sp500, 6) as div_yield2, round(sp500 / dividend, 6) as price_div, round(sp500 / gdp, 6) as price_gdp,
 round(sp500 / fred_gdp, 6) as price_gdp2, round(sp500 / fred_gnp, 6) as price_gnp2, round(div_yield - fred_baa / 100, 6) + 0.0 as div_minus_baa, round((fred_baa - fred_aaa) / 100, 6) as credit_spread,
 round(sp500 / cpi, 6) as real_price2, round(sp500 / fred_cpi, 6) as real_price3, round(sp500_adj / gdp, 6) as real_price_gdp2 from macro"""
)
def cross_ratios(s, d):
    return rounded(X.cross_ratios(I.macro(s, d)).drop(*I.MACRO))


@query(f"with {I.SQL_LONG} select series, date, round(case when value is null then null else ln(greatest(value - 30, 1e-9)) end, 6) as value from m")
def log_floor(s, d):
    return rounded(I.gapped(s, d).withColumn("value", fn.log_floor(F.col("value") - 30)))


@query(f"with {I.SQL_LONG} select series, date, round(case when value > 30 then ln(value - 30) end, 6) as value from m")
def log_unfloored(s, d):
    wide = S.widen(I.gapped(s, d), I.GAPPED).select("date", *((F.col(c) - 30).alias(c) for c in I.GAPPED))
    logs = X.log_transforms(wide, I.GAPPED, None).select("date", *(F.col(f"log_{c}").alias(c) for c in I.GAPPED))
    return rounded(S.lengthen(logs))


@query(f"with {I.SQL_MACRO} select date, round(gdp, 6) as gdp, round(sp500, 6) as sp500 from macro")
def select_features(s, d):
    return rounded(X.select_features(I.macro(s, d), ["gdp", "unknown", "sp500"]))


@query(f"with {I.SQL_LONG} select series, case when ends_with(series, '_d1') then 'd1' when starts_with(series, 'fred_') then 'fred' else 'base' end as grp, count(*) as n from m group by 1, 2")
def feature_groups(s, d):
    return I.gapped(s, d).groupBy("series", fn.feature_group(F.col("series")).alias("grp")).agg(F.count("*").alias("n"))


# Filters, joins, sets.

_WIDE_SQL = f"{I.SQL_LONG}, w as (select date, " + ", ".join(f"max(value) filter (series = '{c}') as {c}" for c in I.GAPPED) + " from m group by 1)"
_COLS = ", ".join(f"round({c}, 6) as {c}" for c in I.GAPPED)


def _wide(s, d):
    return S.widen(I.gapped(s, d), I.GAPPED)


@query(f"with {_WIDE_SQL} select date, {_COLS} from w")
def outer_align_pivot(s, d):
    return rounded(_wide(s, d))


@query(f"with {_WIDE_SQL} select date, {_COLS} from w where date <= coalesce((select max(date) from w where {' and '.join(c + ' is not null' for c in I.GAPPED)}), date)")
def trim_tail(s, d):
    return rounded(S.trim_tail(_wide(s, d)))


@query(f"with {_WIDE_SQL} select date, {_COLS} from w where {' and '.join(c + ' is not null' for c in I.GAPPED)}")
def dropna_any(s, d):
    return rounded(_wide(s, d).dropna("any"))


@query(f"with {_WIDE_SQL} select date, {_COLS} from w where {' or '.join(c + ' is not null' for c in I.GAPPED)}")
def dropna_all(s, d):
    return rounded(_wide(s, d).dropna("all", subset=I.GAPPED))


@query(f"with {_WIDE_SQL} select date, {_COLS} from w where sp500 is not null and gdp is not null")
def dropna_subset(s, d):
    return rounded(_wide(s, d).dropna(subset=["sp500", "gdp"]))


@query(f"with {I.SQL_MACRO} select date, round(gdp, 6) as gdp from macro")
def dropna_columns(s, d):
    wide = I.macro(s, d).select("date", "gdp").join(_wide(s, d).select("date", "sp500"), "date")
    return rounded(X.drop_columns_with_nulls(wide))


@query(f"with {I.SQL_QUARTERS}, {I.SQL_SPINE} select series, date, round(value, 6) as value from dense where date >= date '1998-01-01'")
def date_filter(s, d):
    return rounded(S.densify(I.quarters(s, d)).filter("date >= date '1998-01-01'"))


@query(f"with {I.SQL_RETURNS}, {I.SQL_LABELS} select series, date, round(value, 6) as value, label from r left join (select * from labels_q where label <> 2) using (date)")
def left_align_labels(s, d):
    return rounded(I.returns(s, d).join(I.labels(s, d).filter("label <> 2"), "date", "left").select("series", "date", "value", "label"))


@query(f"with {I.SQL_RETURNS}, {I.SQL_LABELS} select series, date, round(value, 6) as value from r where date in (select date from labels_q where label = 1)")
def semi_future_labels(s, d):
    return rounded(I.returns(s, d).join(I.labels(s, d).filter("label = 1"), "date", "left_semi").select("series", "date", "value"))


@query("select distinct c_mktsegment as series from customer where c_mktsegment not in (select distinct c_mktsegment from customer where c_acctbal > 9990)")
def anti_missing_series(s, d):
    c = I.read(s, d, "customer").select(F.col("c_mktsegment").alias("series"), "c_acctbal")
    return sources.missing(c.select("series"), c.filter("c_acctbal > 9990").select("series"))


@query(f"with {I.SQL_QUARTERS}, {I.SQL_MACRO} select coalesce(a.date, b.date) as date, round(a.value, 6) as price, round(b.sp500, 6) as sp500 from (select * from q where series = '1-URGENT') a full join macro b on a.date = b.date")
def full_outer_join(s, d):
    a = I.quarters(s, d).filter("series = '1-URGENT'").select("date", F.col("value").alias("price"))
    return rounded(a.join(I.macro(s, d).select("date", "sp500"), "date", "full"))


@query(f"with {I.SQL_QUARTERS}, {I.SQL_MACRO} select date from q intersect select date from macro where sp500 > 100")
def date_intersection(s, d):
    return I.quarters(s, d).select("date").intersect(I.macro(s, d).filter("sp500 > 100").select("date"))


@query(f"with {I.SQL_QUARTERS}, {I.SQL_MACRO} select date from macro except select date from q where series = '1-URGENT'")
def date_difference(s, d):
    return I.macro(s, d).select("date").subtract(I.quarters(s, d).filter("series = '1-URGENT'").select("date"))


# Regimes.


@query(f"with {I.SQL_STATS} select label, asset, round(median, 6) as median, round(hit_rate, 6) as hit_rate, n from stats")
def returns_full_stats(s, d):
    return rounded(I.stats(s, d))


@query(f"with {I.SQL_STATS} select label, series as asset, round(avg(value), 6) as mean, round(median(value), 6) as median, round(stddev_samp(value), 6) as std, count(*) as n from r join labels_q using (date) group by 1, 2")
def returns_moments(s, d):
    return rounded(P.return_moments(I.returns(s, d), I.labels(s, d)))


_ASSETS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"with {I.SQL_STATS} select label, " + ", ".join(f"""round(max(median) filter (asset = '{a}'), 6) as "{a}" """ for a in _ASSETS) + " from stats group by 1")
def returns_pivot(s, d):
    return rounded(I.stats(s, d).groupBy("label").pivot("asset", _ASSETS).agg(F.first("median")))


@query(f"with {I.SQL_STATS} select label, asset, round(median, 6) as median, rank from ranked")
def rank_assets(s, d):
    return rounded(I.ranked(s, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {I.SQL_STATS} select label, asset, round(median, 6) as median, rank() over (partition by label order by median desc) + (count(*) over (partition by label, median) - 1) / 2.0 as rank from stats")
def average_ranks(s, d):
    return rounded(P.average_ranks(I.stats(s, d)))


@query(f"with {I.SQL_STATS} select asset, round(median, 6) as median, case when median >= 0.02 then 'GREEN' when median >= 0.0 then 'YELLOW' else 'RED' end as signal, rank from ranked where label = 1")
def asset_signals(s, d):
    return rounded(P.asset_signals(I.ranked(s, d), 1)).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {I.SQL_STATS} select asset, round(1.0 / count(*) over (), 6) as weight from ranked where label = 1 and rank <= 3")
def simple_portfolio(s, d):
    return rounded(P.simple_portfolio(I.ranked(s, d), 1))


_PROBS = [(0, 0.5), (1, 0.3), (2, 0.2), (3, 0.0)]
_SQL_PROBS = "probs as (select * from (values " + ", ".join(map(str, _PROBS)) + ") t(label, prob))"
_SQL_BLEND = f"""{I.SQL_STATS}, {_SQL_PROBS}, b as (select asset, sum(prob::double / c) as w from (select *, count(*) over (partition by label) as c from ranked where rank <= 3) join probs using (label) where prob > 0 group by 1),
target as (select asset, w / (select sum(w) from b) as weight from b)"""


def _blend(s, d):
    return P.blended_portfolio(I.ranked(s, d), s.createDataFrame(_PROBS, "label int, prob double"))


@query(f"with {_SQL_BLEND} select asset, round(weight, 6) as weight from target where weight > 0")
def blended_portfolio(s, d):
    return rounded(_blend(s, d))


_SQL_TRADE = f"""{_SQL_BLEND}, cur as (select asset, 0.25::double as weight from (values ('1-URGENT'), ('2-HIGH'), ('CASH'), ('5-LOW')) t(asset)),
tr as (select coalesce(t.asset, c.asset) as asset, coalesce(c.weight, 0) as now, coalesce(t.weight, 0) as goal from target t full join cur c on t.asset = c.asset),
trades as (select asset, round_even(now * 100, 1) as current_pct, round_even(goal * 100, 1) as target_pct, round_even((goal - now) * 100, 1) as delta_pct,
 case when goal - now > 0.05 then 'BUY' when goal - now < -0.05 then 'SELL' else 'HOLD' end as signal from tr)"""


def _trades(s, d):
    held = s.createDataFrame([(a, 0.25) for a in ("1-URGENT", "2-HIGH", "CASH", "5-LOW")], "asset string, weight double")
    return P.recommendation(_blend(s, d), held)


@query(f"with {_SQL_TRADE} select asset, current_pct, target_pct, delta_pct + 0.0 as delta_pct, signal from trades")
def trade_recommendation(s, d):
    return _trades(s, d).withColumn("delta_pct", F.col("delta_pct") + F.lit(0.0))


@query(f"with {_SQL_TRADE} select count(*) filter (signal = 'BUY') as n_buy, count(*) filter (signal = 'SELL') as n_sell, count(*) filter (signal = 'HOLD') as n_hold from trades")
def signal_counts(s, d):
    return P.signal_counts(_trades(s, d))


_SQL_L = f"{I.SQL_QUARTERS}, {I.SQL_SPINE}, {I.SQL_LABELS}"


@query(
    f"""with {_SQL_L}, st as (select label as f, lead(label) over (order by date) as t from labels_q), c as (select f, t, count(*) as n from st where t is not null group by 1, 2),
 ids as (select distinct label from labels_q), g as (select a.label as from_label, b.label as to_label, coalesce(n, 0) as n from ids a cross join ids b left join c on c.f = a.label and c.t = b.label)
 select from_label, to_label, n, round(n / (case when sum(n) over (partition by from_label) = 0 then 1 else sum(n) over (partition by from_label) end), 6) as prob from g"""
)
def transition_matrix(s, d):
    return rounded(R.transition_matrix(I.labels(s, d)))


for _h in (1, 4, 8):
    QUERIES[f"forward_probabilities_h{_h}"] = lambda s, d, h=_h: rounded(R.forward_probabilities(I.labels(s, d), h))
    ORACLES[f"forward_probabilities_h{_h}"] = f"""with {_SQL_L}, o as (select label, row_number() over (order by date) as t, count(*) over () as n from labels_q),
 ids as (select distinct label from labels_q) select o.label as from_label, ids.label as to_label,
 round(avg(case when exists (select 1 from o p where p.t > o.t and p.t <= o.t + {_h} and p.label = ids.label) then 1.0 else 0.0 end), 6) as prob from o cross join ids where o.t + {_h} <= o.n group by 1, 2"""


_SQL_MLAB = f"{I.SQL_LONG}, ml as (select date, cast((year(date) * 4 + quarter(date)) % 3 as int) as label from macro)"


def _mlabels(s, d):
    return I.macro(s, d).select("date", ((F.year("date") * 4 + F.quarter("date")) % 3).cast("int").alias("label"))


@query(
    f"""with {_SQL_MLAB}, p as (select label, series, avg(value) as mean, median(value) as median, stddev_samp(value) as std from m join ml using (date) group by 1, 2)
 select label, series, stat, round(value, 4) as value from p unpivot include nulls (value for stat in (mean, median, std))"""
)
def profiles_long(s, d):
    return rounded(R.profiles(I.gapped(s, d), _mlabels(s, d)), 4)


_RULES = (("sp500", "High Stocks", "Low Stocks", 0.001), ("gdp", "Strong", "Weak", 0.01), ("cpi", "Dear", "Cheap", 0.001))
_SQL_RULES = ", ".join(f"({k}, '{a}', '{b}', '{c}', {e})" for k, (a, b, c, e) in enumerate(_RULES))


@query(
    f"""with {_SQL_MLAB}, rules as (select * from (values {_SQL_RULES}) t(rank, series, high, low, off)), gm as (select series, median(value) as g from m join ml using (date) group by 1),
 cm as (select label, series, median(value) as c from m join ml using (date) group by 1, 2),
 t as (select label, rank, case when c > g * (1 + off) then high when c < g * (1 - off) then low end as tag from cm join gm using (series) join rules using (series) where g <> 0),
 n as (select label, string_agg(tag, ' / ' order by rank) as name from t where tag is not null group by 1)
 select label, coalesce(name, 'Regime ' || label) as name from (select distinct label from ml) left join n using (label)"""
)
def suggest_names(s, d):
    return R.suggest_names(I.gapped(s, d), _mlabels(s, d), _RULES)


_SQL_TH = f"""{I.SQL_MACRO}, th as (select cast(row_number() over (order by date) as int) as label, fred_aaa / 100 as infl, (fred_baa - 4) / 30 + 0.01 as gdp, div_yield - 0.035 as spread, sp500 - 3800 as sp_d1 from macro)"""


@query(
    f"""with {_SQL_TH}, n as (select label, case when infl > 0.04 and gdp < 0.02 then 'Stagflation' when gdp > 0.03 and sp_d1 > 0 then 'Growth Boom' when spread > 0.015 and sp_d1 < 0 then 'Credit Crisis'
 when infl < 0.03 and gdp > 0.01 and gdp < 0.04 then 'Goldilocks' else 'Transition' end as name from th)
 select label, case when row_number() over (partition by name order by label) > 1 then name || ' (' || label || ')' else name end as name from n"""
)
def legacy_name_rules(s, d):
    m = I.macro(s, d)
    rows = m.select(
        F.row_number().over(S.Window.orderBy("date")).alias("label"),
        (F.col("fred_aaa") / 100).alias("infl"),
        ((F.col("fred_baa") - 4) / 30 + 0.01).alias("gdp"),
        (F.col("div_yield") - 0.035).alias("spread"),
        (F.col("sp500") - 3800).alias("sp_d1"),
    )
    return R.threshold_names(rows)


@query("select coalesce(b.label, a.label) as label, coalesce(b.name, a.name) as name from (select n_nationkey as label, n_name as name from nation where n_nationkey < 20) a full join (select r_regionkey * 6 as label, r_name as name from region) b on a.label = b.label")
def override_merge(s, d):
    auto = I.read(s, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name"))
    return R.override_names(auto, I.read(s, d, "region").select((F.col("r_regionkey") * 6).alias("label"), F.col("r_name").alias("name")))


@query(f"with {I.SQL_POINTS}, c as (select label, row_number() over (order by avg(x[1]), label) - 1 as new from pts group by 1) select id, cast(new as int) as label from pts join c using (label)")
def canonical_labels(s, d):
    return R.canonical(I.points(s, d).select("id", "label", F.col("x")[0].alias("pc1"))).select("id", "label")


@query("with c as (select distinct c_mktsegment from customer where c_mktsegment is not null) select c_custkey, cast(coalesce(code, -1) as int) as code from customer left join (select c_mktsegment, dense_rank() over (order by c_mktsegment) - 1 as code from c) using (c_mktsegment)")
def category_codes(s, d):
    return R.category_codes(I.read(s, d, "customer"), "c_mktsegment").select("c_custkey", "code")


# Statistics.


@query(f"with {I.SQL_LONG} select series, count(value) as n_valid, count(*) as n_total, round(avg(case when value is not null then 1 else 0 end) * 100, 6) as pct from m group by 1")
def coverage_stats(s, d):
    return rounded(T.coverage(I.gapped(s, d)))


@query("select event_type as series, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(min(value), 6) as min, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.75), 6) as q75, round(max(value), 6) as max from events group by 1")
def describe_numeric(s, d):
    return rounded(T.describe(I.read(s, d, "events").select(F.col("event_type").alias("series"), "value")))


@query(f"with {I.SQL_LONG} select a.series as a, b.series as b, round(corr(a.value, b.value), 6) as r, count(*) as n from m a join m b using (date) where a.value is not null and b.value is not null group by 1, 2")
def correlation_matrix(s, d):
    return rounded(T.correlations(I.gapped(s, d)))


@query(f"with {I.SQL_LONG} select series, round(var_samp(value), 4) as variance from m group by 1 order by 2 desc limit 3")
def variance_top(s, d):
    return rounded(T.top_variance(I.gapped(s, d), 3), 4)


@query(
    """with k as (select event_type as series, value from events where value is not null), sp as (select series, min(value) as lo, max(value) as hi, count(*) as total from k group by 1),
 b as (select series, cast(case when hi = lo then 1 else least(floor((value - lo) * 30 / (hi - lo)) + 1, 30) end as int) as bin, lo, hi, total, count(*) as n from k join sp using (series) group by all)
 select series, bin, round(lo + (bin - 1) * ((hi - lo) / 30), 6) as low, n, round(n / nullif(total * ((hi - lo) / 30), 0), 6) as density from b"""
)
def histogram(s, d):
    return rounded(T.histogram(I.read(s, d, "events").select(F.col("event_type").alias("series"), "value")))


@query(
    f"""with {_SQL_MLAB}, o as (select * from m join ml using (date) where value is not null), qs as (select label, series, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.75) as q75 from o group by 1, 2)
 select label, series, round(q25, 4) as q25, round(q50, 4) as q50, round(q75, 4) as q75, round(min(value), 4) as low, round(max(value), 4) as high from o join qs using (label, series)
 where value between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25) group by all"""
)
def boxplot_stats(s, d):
    return rounded(T.box_stats(I.gapped(s, d), _mlabels(s, d)), 4)


@query("select event_type, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from events group by 1")
def value_counts_share(s, d):
    return rounded(T.value_counts(I.read(s, d, "events"), "event_type"))


@query("select p_brand as series, cast((row_number() over (order by p_brand) - 1) // 8 as int) as page from (select distinct p_brand from part)")
def series_pages(s, d):
    return T.pages(I.read(s, d, "part").select(F.col("p_brand").alias("series")))


# Measures of clusterings and classifiers.

_P = I.SQL_POINTS
_SQL_CENTERS = """fl as (select id, label, unnest(x) as v, unnest(range(1, len(x) + 1)) as i from pts), ce as (select label, list(m order by i) as c, max(n) as n from (select label, i, avg(v) as m, count(*) as n from fl group by 1, 2) group by 1)"""


@query(f"with {_P}, fl as (select id, unnest(x) as v, unnest(range(1, len(x) + 1)) as i from pts) select id, cast(i - 1 as int) as i, round((v - avg(v) over (partition by i)) / coalesce(nullif(stddev_pop(v) over (partition by i), 0), 1), 5) + 0.0 as z from fl")
def standardize_pop(s, d):
    z = L.standardize(I.points(s, d).select("id", "x"))
    return rounded(z.select("id", F.posexplode("x").alias("i", "z")), 5)


@query(f"with {_P}, {_SQL_CENTERS} select round(sum(pow(list_distance(x, c), 2)), 4) as inertia from pts join ce using (label)")
def inertia(s, d):
    return rounded(M.inertia(I.points(s, d)), 4)


_SQL_SIL = """dd as (select a.id, a.label, b.label as l2, sum(list_distance(a.x, b.x)) as sm, count(*) as n from pts a cross join pts b group by 1, 2, 3),
ab as (select id, label, max(sm / nullif(n - 1, 0)) filter (label = l2) as a, max(n) filter (label = l2) as n, min(sm / n) filter (label <> l2) as b from dd group by 1, 2),
sil as (select id, label, case when n = 1 then 0.0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) end as s from ab)"""


@query(f"with {_P}, {_SQL_SIL} select id, label, round(s, 5) + 0.0 as s from sil")
def silhouette(s, d):
    return rounded(M.silhouettes(I.points(s, d)), 5)


_SQL_CH = """wi as (select sum(pow(list_distance(x, c), 2)) as w from pts join ce using (label)),
gg as (select list(m order by i) as g from (select i, avg(v) as m from fl group by 1)), be as (select sum(n * pow(list_distance(c, g), 2)) as b, sum(n) as n, count(*) as k from ce cross join gg),
ch as (select case when w = 0 then 1.0 else b * (n - k) / (w * (k - 1)) end as calinski_harabasz from be cross join wi)"""
_SQL_DB = """spd as (select label, c, avg(list_distance(x, c)) as s from pts join ce using (label) group by 1, 2),
dbx as (select avg(r) as davies_bouldin from (select a.label, max((a.s + b.s) / nullif(list_distance(a.c, b.c), 0)) as r from spd a join spd b on a.label <> b.label group by 1))"""


@query(f"with {_P}, {_SQL_CENTERS}, {_SQL_CH} select round(calinski_harabasz, 5) as calinski_harabasz from ch")
def calinski_harabasz(s, d):
    return rounded(M.calinski_harabasz(I.points(s, d)), 5)


@query(f"with {_P}, {_SQL_CENTERS}, {_SQL_DB} select round(davies_bouldin, 5) as davies_bouldin from dbx")
def davies_bouldin(s, d):
    return rounded(M.davies_bouldin(I.points(s, d)), 5)


_SQL_METHODS = f"{_P}, ms as (select id, 'a' as method, label from pts union all select id, 'b', cast(id % 7 as int) from pts union all select id, 'c', cast(case when id % 10 = 0 then -1 else label // 2 end as int) from pts)"


def _methods(s, d):
    p = I.points(s, d)
    a = p.select("id", F.lit("a").alias("method"), F.col("label").cast("int").alias("label"))
    b = p.select("id", F.lit("b").alias("method"), (F.col("id") % 7).cast("int").alias("label"))
    c = p.select("id", F.lit("c").alias("method"), F.when(F.col("id") % 10 == 0, -1).otherwise(F.floor(F.col("label") / 2)).cast("int").alias("label"))
    return a.unionByName(b).unionByName(c)


@query(
    f"""with {_SQL_METHODS}, cells as (select a.method as a, b.method as b, a.label as la, b.label as lb, count(*) as n from ms a join ms b using (id) where a.label >= 0 and b.label >= 0 group by 1, 2, 3, 4),
 ra as (select a, b, sum(n * (n - 1) / 2) as ra, sum(n) as n from (select a, b, la, sum(n) as n from cells group by 1, 2, 3) group by 1, 2), rb as (select a, b, sum(n * (n - 1) / 2) as rb from (select a, b, lb, sum(n) as n from cells group by 1, 2, 3) group by 1, 2),
 s as (select a, b, sum(n * (n - 1) / 2) as same from cells group by 1, 2)
 select a, b, round((same - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 5) + 0.0 as ari from s join ra using (a, b) join rb using (a, b)"""
)
def pairwise_ari(s, d):
    return rounded(M.rand_index(_methods(s, d)), 5)


def _sql_method(m: str, label: str, where: str) -> str:
    return f"""(with pts as (select id, {label} as label, x from pts0 where {where}), {_SQL_CENTERS}, {_SQL_SIL}, {_SQL_CH}, {_SQL_DB}
 select '{m}' as method, (select count(distinct label) from pts) as clusters, (select count(*) from pts0) - (select count(*) from pts) as noise, round((select avg(s) from sil), 5) as silhouette,
 round((select davies_bouldin from dbx), 5) as davies_bouldin, round((select calinski_harabasz from ch), 5) as calinski_harabasz)"""


@query("with " + _P.replace("pts as", "pts0 as", 1) + ", r as (" + " union all ".join((_sql_method("a", "label", "true"), _sql_method("b", "cast(id % 7 as int)", "true"), _sql_method("c", "label // 2", "id % 10 <> 0"))) + ") select * from r")
def compare_methods(s, d):
    return rounded(M.compare_methods(I.points(s, d), _methods(s, d)), 5)


@query(f"with {_P}, n as (select a.id, list_distance(a.x, b.x) as dist, row_number() over (partition by a.id order by list_distance(a.x, b.x), b.id) as rn from pts a cross join pts b) select id, round(dist, 6) as d from n where rn = 5")
def knn_distances(s, d):
    return rounded(D.knn_distances(I.points(s, d)))


_EPS = 1.2


@query(
    f"""with recursive {_P}, nb as (select a.id, b.id as other from pts a cross join pts b where list_distance(a.x, b.x) <= {_EPS}), core as (select id from nb group by 1 having count(*) >= 5),
 ed as (select id, other from nb where id in (select id from core) and other in (select id from core)),
 reach(id, root) as (select id, id from core union select ed.other, reach.root from reach join ed on ed.id = reach.id),
 roots as (select id, min(root) as root from reach group by 1), num as (select root, row_number() over (order by root) - 1 as label from (select distinct root from roots)),
 lab as (select id, label from roots join num using (root)), bo as (select nb.id, min(label) as label from nb join lab on lab.id = nb.other where nb.id not in (select id from core) group by 1)
 select id, cast(coalesce(lab.label, bo.label, -1) as int) as label from pts left join lab using (id) left join bo using (id)"""
)
def dbscan_labels(s, d):
    return D.dbscan(I.points(s, d).select("id", "x"), _EPS, 5)


@query(
    f"""with {_P}, n as (select a.id, b.id as other, row_number() over (partition by a.id order by list_distance(a.x, b.x), b.id) as rn from pts a cross join pts b), o as (select id, other from n where rn <= 10)
 select id, other, count(*) / 2.0 as w from (select id, other from o union all select other, id from o) group by 1, 2"""
)
def knn_affinity(s, d):
    return D.affinity(I.points(s, d))


@query(
    f"""with {_SQL_L}, o as (select date, label, row_number() over (order by date) - 1 as rn, count(*) over () as n from labels_q), f as (select *, unnest(range(1, 6)) as fold from o),
 t as (select *, n - (5 - fold + 1) * (n // 6) as a, n // 6 as ts from f) select cast(fold as int) as fold, case when rn < a then 'train' else 'test' end as role, date, label from t where rn < a + ts"""
)
def time_series_split(s, d):
    return M.time_series_split(I.labels(s, d))


@query(f"with {_SQL_L}, o as (select date, label, row_number() over (order by date) as rn, count(*) over () as n from labels_q) select case when rn <= n - ceil(n * 0.2) then 'train' else 'test' end as role, date, label from o")
def chronological_holdout(s, d):
    return M.holdout(I.labels(s, d))


_SQL_PRED = "pr as (select l.doc_id, l.quality as actual, cast(case when n_chars > 2000 then 0 else 1 end as int) as predicted from labels l join documents using (doc_id))"


def _predictions(s, d):
    docs = I.read(s, d, "documents").select("doc_id", "n_chars")
    return I.read(s, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").cast("int").alias("actual"), F.when(F.col("n_chars") > 2000, 0).otherwise(1).alias("predicted"))


@query(f"with {_SQL_PRED}, g as (select distinct actual as k from pr union select distinct predicted from pr) select cast(a.k as int) as actual, cast(b.k as int) as predicted, count(pr.doc_id) as n from g a cross join g b left join pr on pr.actual = a.k and pr.predicted = b.k group by 1, 2")
def confusion_matrix(s, d):
    return M.confusion(_predictions(s, d))


@query(
    f"""with {_SQL_PRED}, r as (select k, count(*) filter (actual = k and predicted = k) as tp, count(*) filter (predicted = k) as found, count(*) filter (actual = k) as support from pr cross join (values (0), (1)) t(k) group by 1),
 m as (select cast(k as varchar) as class, coalesce(tp / nullif(found, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, support from r),
 f as (select class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1, support from m),
 a as (select * from f union all select 'macro', avg(precision), avg(recall), avg(f1), sum(support) from f union all select 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from f)
 select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from a"""
)
def classification_report(s, d):
    return rounded(M.report(_predictions(s, d)))


@query(f"with {_P} select round(avg(case when label = id % 10 then 1 else 0 end), 6) as agreement, count(*) as n from pts")
def agreement_rate(s, d):
    p = I.points(s, d)
    return rounded(M.agreement(p, p.select("id", (F.col("id") % 10).alias("label"))))


_SQL_SCORES = "sc as (select * from (select r_regionkey + 2 as k, cast(length(r_name) * 0.1 as double) as gap, cast(0.05 as double) as s, cast(100.0 / (r_regionkey + 1) as double) as inertia, cast(((r_regionkey * 3) % 4) * 0.1 as double) as silhouette from region))"


def _scores(s, d):
    key = F.col("r_regionkey")
    return I.read(s, d, "region").select((key + 2).alias("k"), (F.length("r_name") * 0.1).alias("gap"), F.lit(0.05).alias("s"), (F.lit(100.0) / (key + 1)).alias("inertia"), ((key * 3 % 4) * 0.1).alias("silhouette"))


@query(f"with {_SQL_SCORES} select coalesce(min(k) filter (ok), max(k)) as best_k from (select k, gap >= lead(gap) over (order by k) - lead(s) over (order by k) as ok from sc)")
def gap_optimal_k(s, d):
    return M.optimal_gap_k(_scores(s, d))


def _sql_grad(src: str, c: str, to: str) -> str:
    return f"(select *, case when lag({c}) over (order by k) is null then lead({c}) over (order by k) - {c} when lead({c}) over (order by k) is null then {c} - lag({c}) over (order by k) else (lead({c}) over (order by k) - lag({c}) over (order by k)) / 2 end as {to} from {src})"


@query(f"with {_SQL_SCORES} select arg_max(k, (g2, -k)) as knee_k from {_sql_grad(_sql_grad('sc', 'inertia', 'g'), 'g', 'g2')}")
def knee_k(s, d):
    return M.knee_k(_scores(s, d))


@query(f"with {_SQL_SCORES} select least(arg_max(k, (silhouette, -k)), 4) as best_k from sc")
def pick_best_k(s, d):
    return M.pick_k(_scores(s, d), 4)


@query(
    """with im as (select p_brand as feature, avg(p_retailprice) as importance from part where p_size < 45 group by 1 having count(*) > 3), rk as (select *, row_number() over (order by importance desc, feature) as rank from im)
 select feature, round(importance, 6) as importance, coalesce(rank, (select count(*) from im) + 1) as rank, coalesce(rank <= 10, false) as recommended from (select distinct p_brand as feature from part) left join rk using (feature)"""
)
def feature_recommendation(s, d):
    part = I.read(s, d, "part")
    known = part.filter("p_size < 45").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"), F.count("*").alias("n")).filter("n > 3").drop("n")
    return rounded(M.recommend_features(known, part.select(F.col("p_brand").alias("feature")).distinct(), 10))


# Sources.


@query(
    """with raw as (select o_orderkey, case cast(o_orderkey % 4 as int) when 0 then 'percent' when 1 then 'million' when 2 then 'trillion' else 'num' end as kind,
 printf('%.2f', o_totalprice) as txt from orders) select o_orderkey, kind, round(case when kind = 'percent' then txt::double / 100 when o_orderkey % 20 = 3 then null else txt::double end, 6) as value from raw"""
)
def parse_multi_unit(s, d):
    o = I.read(s, d, "orders")
    kind = F.when(F.col("o_orderkey") % 4 == 0, "percent").when(F.col("o_orderkey") % 4 == 1, "million").when(F.col("o_orderkey") % 4 == 2, "trillion").otherwise("num")
    rows = o.select("o_orderkey", kind.alias("kind"), F.format_number("o_totalprice", 2).alias("txt"))
    tail = F.when(F.col("kind") == "percent", "%").when(F.col("kind") == "num", "").otherwise(F.concat(F.lit(" "), F.col("kind")))
    text = F.when(F.col("o_orderkey") % 20 == 3, "").otherwise(F.concat("txt", tail))
    return rounded(rows.select("o_orderkey", "kind", fn.parse_number(text, F.col("kind")).alias("value")))


@query("select o_orderkey, cast(o_orderdate as date) as date from orders")
def parse_dates(s, d):
    o = I.read(s, d, "orders")
    return o.select("o_orderkey", fn.parse_date(F.date_format("o_orderdate", "MMM d, yyyy")).alias("date"))


@query("select page_id, len(regexp_extract_all(html, '(?s)<a [^>]*>(.*?)</a>')) as links, len(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>')) as paragraphs from pages")
def html_cells(s, d):
    n = lambda tag: F.size(F.regexp_extract_all("html", F.lit(f"(?s)<{tag}>(.*?)</{tag.split('[')[0].strip()}>"), F.lit(1))).cast("long")
    return I.read(s, d, "pages").select("page_id", n("a [^>]*").alias("links"), n("p[^>]*").alias("paragraphs"))


@query(
    """with t as (select series, date, max_by(value, i) as value from (select n_regionkey::varchar as series, n_nationkey as i, n_nationkey * 1.5 as value, date '2020-03-31' as date from nation) group by 1, 2) select series, date, value::double as value from t"""
)
def scraped_table(s, d):
    n = I.read(s, d, "nation")
    row = F.concat(F.lit("<tr class='r'><td>Jan "), (F.col("n_nationkey") + 1).cast("string"), F.lit(", 2020</td>\n<td> <b>"), F.format_string("%.1f", F.col("n_nationkey") * 1.5), F.lit("</b> </td></tr>"))
    page = n.groupBy(F.col("n_regionkey").cast("string").alias("series")).agg(F.concat(F.lit("<table id='datatable'><tr><th>Date</th><th>Value</th></tr>"), F.array_join(F.sort_array(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))
    return sources.typed(sources.scrape(page).withColumn("kind", F.lit("num")))


@query(
    f"""with e as (select cast(ts as date) as date, event_type as primary_class, ts, event_id from events), codes as (select event_type, dense_rank() over (order by event_type) - 1 as code from (select distinct event_type from events where event_type is not null)),
 j as (select date, coalesce(code, -1) as code from e left join codes on codes.event_type = e.primary_class) select {I.QE.format('date')} as date, cast(arg_max(code, (date, code)) as int) as market_code from j group by 1"""
)
def label_codes(s, d):
    return sources.labels(I.read(s, d, "events").select(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("primary_class")))


# What plots read, and the rest.


@query(f"with {I.SQL_LONG} select series, date, cast(value is not null as int) as known from m")
def coverage_matrix(s, d):
    return V.coverage_matrix(I.gapped(s, d))


@query(f"with {_SQL_L} select date, cast(date + 92 as date) as until, label, cast(label % 5 as int) as color from labels_q")
def regime_timeline(s, d):
    return V.timeline(I.labels(s, d))


@query(f"with {_SQL_SCORES} select k, round(silhouette, 6) as silhouette, round(inertia / max(inertia) over (), 6) as calinski_scaled, round(1.0 / (gap + 1), 6) as davies_inverse from sc")
def scaled_scores(s, d):
    return rounded(V.scaled_scores(_scores(s, d).select("k", "silhouette", F.col("inertia").alias("calinski_harabasz"), (F.col("gap") + 1).alias("davies_bouldin"))))


@query(f"with {_SQL_L}, p as (select date, cast(case when month(date) = 12 then -1 else (label + 1) % 4 end as int) as label from labels_q) select p.date, p.label as predicted, a.label as actual from p join labels_q a using (date) where p.label >= 0")
def predicted_vs_actual(s, d):
    actual = I.labels(s, d)
    predicted = actual.select("date", F.when(F.month("date") == 12, -1).otherwise((F.col("label") + 1) % 4).cast("int").alias("label"))
    return V.predicted_vs_actual(predicted, actual)


@query(
    f"""with {I.SQL_STATS}, o as (select label, series, value from r join labels_q using (date)), sp as (select label, series, min(value) as lo, max(value) as hi, count(*) as total from o group by 1, 2 having count(*) >= 3),
 b as (select label, series, cast(case when hi = lo then 1 else least(floor((value - lo) * 15 / (hi - lo)) + 1, 15) end as int) as bin, lo, hi, total, count(*) as n from o join sp using (label, series) group by all)
 select label, series, bin, round(lo + (bin - 1) * ((hi - lo) / 15), 6) + 0.0 as low, n, round(n / nullif(total * ((hi - lo) / 15), 0), 6) as density from b"""
)
def return_histograms(s, d):
    return rounded(V.return_histograms(I.returns(s, d), I.labels(s, d)))


@query(f"with {_SQL_L}, {I.SQL_MACRO}, a as (select date, label, row_number() over (order by date) as i from labels_q), b as (select date as date_2, round(gdp, 6) as gdp_2, row_number() over (order by date) as i from macro where gdp is not null and month(date) <> 3) select date, label, date_2, gdp_2 from a join b using (i)")
def positional_zip(s, d):
    return rounded(V.zip_by_position(I.labels(s, d), I.macro(s, d).filter("month(date) <> 3").select("date", "gdp")))


@query(f"with {_SQL_L}, {I.SQL_MACRO} select date, round(price_div, 6) as price_div, coalesce(label, -1) as market_code from (select date, sp500 / dividend as price_div from macro where date between date '1996-01-01' and date '2000-12-31') left join (select * from labels_q where label <> 1) using (date)")
def legacy_merge(s, d):
    wide = X.cross_ratios(I.macro(s, d)).filter("date between date '1996-01-01' and date '2000-12-31'")
    return rounded(wide.join(I.labels(s, d).filter("label <> 1"), "date", "left").select("date", "price_div", F.coalesce("label", F.lit(-1)).alias("market_code")))


@query(f"with {_SQL_L}, t as (select date, lead(label, 2) over (order by date) as y from labels_q) select date, cast(y = 1 as int) as label from t where y is not null")
def forward_targets(s, d):
    return L.forward_targets(I.labels(s, d), 2, 1)


@query(f"with {_SQL_L}, n as (select label, count(*) as n, count(*) over () as k, sum(count(*)) over () as total from labels_q group by 1) select date, label, round(total / (k * n), 6) as weight from labels_q join n using (label)")
def class_weights(s, d):
    return rounded(L.class_weights(I.labels(s, d)).select("date", "label", "weight"))


@query(f"with {I.SQL_MACRO} select date, round(sp500, 6) as sp500 from macro order by date desc limit 1")
def latest_row(s, d):
    return rounded(I.macro(s, d).select("date", "sp500").orderBy(F.desc("date")).limit(1))


@query(f"with {I.SQL_LONG} select round(min(value), 4) as low, round(max(value), 4) as high, series from m group by series")
def bounding_box(s, d):
    return rounded(I.gapped(s, d).groupBy("series").agg(F.min("value").alias("low"), F.max("value").alias("high")), 4)


# Models: no SQL says them; tests hold their properties.


@query()
def pca_scores(s, d):
    p = I.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return rounded(L.pca(p, 5).select("id", *(F.col("x")[k].alias(f"PC{k + 1}") for k in range(5))), 4)


@query()
def kmeans_sweep(s, d):
    return rounded(L.kmeans_sweep(I.scores(s, d)), 4)


@query()
def balanced_kmeans(s, d):
    return L.balanced_kmeans(I.scores(s, d))


@query()
def gmm_bic(s, d):
    return rounded(L.gmm_sweep(I.scores(s, d)).drop("resp"), 4)


@query()
def gap_statistic(s, d):
    return rounded(L.gap_statistic(I.scores(s, d)), 4)


@query()
def spectral_labels(s, d):
    return L.spectral(I.scores(s, d), 4)


@query()
def hdbscan_labels(s, d):
    return H.hdbscan(I.scores(s, d))


@query()
def svd_loadings(s, d):
    return rounded(L.loadings(I.points(s, d), 3), 4)


@query()
def dbscan_sweep(s, d):
    return rounded(L.dbscan_sweep(I.scores(s, d)), 4)


@query()
def forward_rf(s, d):
    rows = I.macro(s, d).join(I.labels(s, d), "date").select("date", "label", F.array("sp500", "gdp", "cpi").alias("x"))
    out = None
    for h, by_label in L.train_forward(rows).items():
        for k, model in by_label.items():
            own = L.predict(model, rows).select("date", "label", F.lit(h).alias("horizon"), F.lit(k).alias("regime"), "predicted", F.col("probabilities")[1].alias("prob"))
            out = own if out is None else out.unionByName(own)
    return rounded(out, 4)


@query()
def rf_regime(s, d):
    e = I.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    model = L.train_classifier(e)
    return L.predict(model, e).select("id", "label", "predicted")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Stoplights of assets by their median quarterly return in the current regime."""
    last = I.labels(spark, d).orderBy(F.desc("date")).first()
    return P.asset_signals(I.ranked(spark, d), last.label)


from . import stored  # noqa: E402,F401  registers its queries here
