"""Queries over what is fetched, stored and read again, and over models whose results SQL can say."""
from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import learn as L
from ..operators import reports as V
from ..operators import series as S
from ..operators.checkpoints import Checkpoints
from ..session import ensure_checkpoint_dir
from . import inputs as I
from .queries import _SQL_L, query, rounded


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


_SQL_Q = f"with {I.SQL_QUARTERS} select series, date, round(value, 6) as value from q"


@query(_SQL_Q)
def checkpoint_round_trip(s, d):
    kept = Checkpoints(s, _folder(s), "settings")
    kept.save(I.quarters(s, d), "quarters")
    return rounded(kept.load("quarters"))


@query(
    f"""with {_SQL_L}, {I.SQL_MACRO}, n as (select 'labels' as name, (select count(*) from labels_q) || 'x2' as shape union all select 'macro', (select count(*) from macro) || 'x2')
 select name, shape, left(md5('settings'), 8) as config_hash from n"""
)
def checkpoint_summary(s, d):
    kept = Checkpoints(s, _folder(s), "settings")
    kept.save(I.labels(s, d), "labels")
    kept.save(I.macro(s, d).select("date", "gdp"), "macro")
    kept.save(I.labels(s, d), "gone")
    kept.clear("gone")
    return kept.summary().select("name", "shape", "config_hash")


@query("select * from (values ('saved', true), ('same settings', true), ('other settings', false), ('too old', false), ('missing', false)) t(what, fresh)")
def checkpoint_freshness(s, d):
    where = _folder(s)
    kept, other = Checkpoints(s, where, "settings"), Checkpoints(s, where, "others")
    kept.save(I.labels(s, d), "labels")
    rows = [("saved", kept.is_fresh("labels")), ("same settings", kept.is_fresh("labels", 7.0, True)), ("other settings", other.is_fresh("labels", 7.0, True)), ("too old", kept.is_fresh("labels", -1.0)), ("missing", kept.is_fresh("nothing"))]
    return s.createDataFrame(rows, "what string, fresh boolean")


@query(f"with {_SQL_L} select date, label + 10 as label from labels_q")
def snapshot_round_trip(s, d):
    kept = Checkpoints(s, _folder(s))
    labels = I.labels(s, d)
    kept.save_snapshot(labels, "states", "2024-03-31")
    kept.save_snapshot(labels.withColumn("label", F.col("label") + 20), "states", "2024-06-30")
    kept.save_snapshot(labels.withColumn("label", F.col("label") + 10), "states", "2024-03-31")
    return kept.load_snapshot("states", "2024-03-31").select("date", "label")


@query(f"with {_SQL_L} select cast(date as varchar) as date, cast(label as varchar) as label from labels_q")
def table_and_csv(s, d):
    where = _folder(s)
    Checkpoints(s, where).save_both(I.labels(s, d), "labels")
    return s.read.option("header", True).csv(f"{where}/labels.csv")


@query("select n_name, cast(n_nationkey as varchar) as n_nationkey from nation")
def csv_report(s, d):
    where = _folder(s)
    V.write_csv(I.read(s, d, "nation").select("n_name", "n_nationkey"), where)
    return s.read.option("header", True).csv(where)


@query(_SQL_Q)
def parquet_or_fallback(s, d):
    """The fallback's table is written, and is what the second reader finds."""
    where = _folder(s)
    sources.parquet_or(s, where, lambda: I.quarters(s, d))
    return rounded(sources.parquet_or(s, where, lambda: I.quarters(s, d).limit(0)))


@query("select trim(n_name) as name, n_nationkey from nation")
def trimmed_cells(s, d):
    n = I.read(s, d, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias(" name "), F.col("n_nationkey").alias(" n_nationkey"))
    return sources.trimmed(n)


def _label_files(s: SparkSession, d: str) -> str:
    """Two dated label files; the newer one knows the later half of the event types only."""
    where = _folder(s)
    rows = I.read(s, d, "events").select(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("primary_class"))
    rows.write.parquet(f"{where}/labels_20230101.parquet")
    rows.filter("month(date) > 3").write.parquet(f"{where}/labels_20240101.parquet")
    return f"{where}/labels_*.parquet"


_SQL_LABEL_FILE = f"""with e as (select cast(ts as date) as date, event_type as primary_class from events where month(cast(ts as date)) > 3), codes as (select primary_class as event_type, dense_rank() over (order by primary_class) - 1 as code from (select distinct primary_class from e where primary_class is not null)),
 j as (select date, coalesce(code, -1) as code from e left join codes on codes.event_type = e.primary_class), f as (select {I.QE.format('date')} as date, cast(arg_max(code, (date, code)) as int) as market_code from j group by 1)"""


@query(f"{_SQL_LABEL_FILE} select * from f")
def newest_label_file(s, d):
    return sources.newest_labels(s, _label_files(s, d))


@query(f"{_SQL_LABEL_FILE.replace('with e', f'with {_SQL_L}, e', 1)} select 'file' as source, date, market_code as label from f union all select 'clustered', date, label from labels_q")
def label_dispatch(s, d):
    """Labels by name: the newest file, a checkpoint; a name without one has no rows."""
    kept, pattern = Checkpoints(s, _folder(s)), _label_files(s, d)
    kept.save(I.labels(s, d), "market_code_clustered")
    if sources.label_source(kept, "predicted", pattern) is not None:
        raise ValueError("there are no predicted labels")
    found = [(k, sources.label_source(kept, k, pattern)) for k in ("file", "clustered")]
    return found[0][1].select(F.lit("file").alias("source"), "date", "label").unionByName(found[1][1].select(F.lit("clustered").alias("source"), "date", "label"))


@query(_SQL_Q)
def price_fallbacks(s, d):
    """A batch download lacks tickers, the next source fails, the one after has some, the last has the rest and one more."""
    own = I.prices(s, d)
    tickers = sorted(r.series for r in own.select("series").distinct().collect())
    quarters = I.quarters(s, d)

    def batch(still: list[str]) -> DataFrame:
        last = own.filter(F.col("series").isin(still[:2])).groupBy("series", "date").agg(F.max_by("value", F.struct("tie", "value")).alias("value"))
        time = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00-05:00"))
        rows = last.select(time.alias("time"), F.col("series").alias("ticker"), F.explode(F.map_from_arrays(F.array(F.lit("Close"), F.lit("Open")), F.array("value", F.lit(0.0)))).alias("field", "value"))
        return sources.close_prices(rows.unionByName(rows.withColumn("value", F.lit(float("nan")))))

    def broken(still: list[str]) -> DataFrame:
        raise ConnectionError("no such host")

    def asked(still: list[str]) -> DataFrame:
        if still != tickers[2:]:
            raise ValueError(f"asked for {still}")
        return quarters.filter(F.col("series") == still[0])

    def rest(still: list[str]) -> DataFrame:
        return quarters.filter(F.col("series").isin(still))

    return rounded(sources.price_chain(s, tickers, batch, broken, asked, lambda still: None, rest))


def _service(s: SparkSession, d: str) -> dict[str, list[tuple[dt.date, float]]]:
    """What a service would answer: the dearest order of each month in three series. Its size is that of the calendar."""
    rows = I.read(s, d, "orders").select(F.concat(F.lit("K"), F.col("o_orderkey") % 3).alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), "o_totalprice")
    out: dict[str, list[tuple[dt.date, float]]] = {}
    for r in rows.groupBy("series", "month").agg(F.max("o_totalprice").alias("v")).orderBy("series", "month").collect():
        out.setdefault(r.series, []).append((r.month, r.v))
    return out


_SQL_SERVICE = f"""m as (select 'K' || (o_orderkey % 3) as series, cast(date_trunc('month', o_orderdate) as date) as month, max(o_totalprice) as v from orders group by 1, 2),
q as (select series, {I.QE.format("month")} as date, arg_max(v, month) as value from m group by 1, 2)"""


@query(f"with {_SQL_SERVICE} select series, date, round(case when series = 'K1' then lag(value) over (partition by series order by date) else value end, 6) as value from q")
def keyed_series(s, d):
    """A service that wants a key, and knows no series X; K1 comes a quarter late."""
    known = _service(s, d)

    def fetch(key: str, series: str) -> list[tuple]:
        if key != "key" or series not in known:
            raise OSError("refused")
        return known[series]

    return rounded(sources.keyed_series(s, [*sorted(known), "X"], "key", fetch, late=["K1"]))


@query(f"with {_SQL_SERVICE} select series, date, round(value, 6) as value from q")
def retried_series(s, d):
    """Every series is refused at first and fetched when asked again."""
    known, asked = _service(s, d), {}

    def fetch(series: str) -> list[tuple]:
        asked[series] = asked.get(series, 0) + 1
        if asked[series] == 1:
            raise OSError("busy")
        return known[series]

    sources.register_fetcher(s, "retried_series", sources.retrying(fetch, 3, 0.01))
    rows = s.read.format("retried_series").option("series", ",".join(sorted(known))).load()
    return rounded(S.resample_last(rows))


@query(f"with {_SQL_SERVICE} select series, date, round(case when series = 'K2' then round(value, 2) / 100 else round(value, 2) end, 6) as value from q where series <> 'K1'")
def scraped_datasets(s, d):
    """Text cells of pages, those of K2 percentages; K1's page cannot be reached."""
    known = _service(s, d)

    def page(name: str) -> list[tuple]:
        if name == "K1":
            raise OSError("no such page")
        return [(f"{day:%b} {day.day}, {day.year}", f"{v:,.2f}{'%' if name == 'K2' else ''}") for day, v in known[name]]

    return rounded(sources.scrape_datasets(s, {"K0": "num", "K1": "num", "K2": "percent"}, page, pause=0.01))


@query("select r_regionkey as label, upper(r_name) as name from region")
def names_round_trip(s, d):
    """Names written as YAML and read back as overrides."""
    with tempfile.TemporaryDirectory() as folder:  # a file of the driver, as people keep it
        path = f"{folder}/names.yaml"
        V.write_names(path, {r.r_regionkey: r.r_name.upper() for r in I.read(s, d, "region").collect()})
        found = sources.name_overrides(path)
    return s.createDataFrame(list(found.items()), "label int, name string")


@query("with im as (select p_brand as feature, avg(p_retailprice) as importance from part group by 1) select cast(row_number() over (order by importance desc, feature) as int) as rank, feature, round(importance, 6) as importance from im qualify rank <= 20")
def importance_frame(s, d):
    found = I.read(s, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    return rounded(V.top_importances(found, 20))


@query(_SQL_Q)
def first_source_with_rows(s, d):
    def broken():
        raise OSError("no such store")

    return rounded(V.validate(sources.first_with_rows(broken, lambda: None, lambda: I.quarters(s, d).limit(0), lambda: I.quarters(s, d)), 1, ["date", "value"]))


# Models that a rule of the data fits exactly, so that SQL can say what they predict.


def _lines(s: SparkSession, d: str) -> DataFrame:
    rows = I.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"))
    return rows.select("l_orderkey", "l_linenumber", "date", F.array(F.col("l_linenumber").cast("double"), (F.col("l_orderkey") % 5).cast("double")).alias("x"), F.when(F.col("l_linenumber") <= 2, 0).when(F.col("l_linenumber") <= 5, 1).otherwise(2).alias("label"))


_SQL_RULE = "cast(case when l_linenumber <= 2 then 0 when l_linenumber <= 5 then 1 else 2 end as int)"


@query(f"select l_orderkey, l_linenumber, {_SQL_RULE} as predicted from lineitem")
def tree_regime(s, d):
    rows = _lines(s, d)
    return L.predict(L.train_decision_tree(rows), rows).select("l_orderkey", "l_linenumber", "predicted")


@query("select 5 as folds, 1.0::double as mean, 0.0::double as std, 1 as features_used")
def tree_cross_validation(s, d):
    _, found = L.train_with_metrics(_lines(s, d), ["line", "order"], "dt")
    used = found["feature_importances"].filter("importance > 0").count()
    return s.createDataFrame([(len(found["cv_accuracies"]), found["mean_cv_accuracy"], found["std_cv_accuracy"], used)], "folds int, mean double, std double, features_used int")


@query(f"with l as (select cast(l_shipdate as date) as date, l_orderkey, l_linenumber, {_SQL_RULE} as label from lineitem where l_linenumber <> 6 order by 1 desc, 2 desc, 3 desc limit 1) select date, label as predicted, cast(k as int) as label, cast(k = label as int)::double as prob from l cross join range(0, 3) t(k)")
def current_regime(s, d):
    rows = _lines(s, d).filter("l_linenumber <> 6")
    model = L.train_decision_tree(rows)
    last = rows.orderBy(F.desc("date"), F.desc("l_orderkey"), F.desc("l_linenumber")).limit(1)
    return rounded(L.predict_current(model, last).select("date", "predicted", "label", "prob"))


@query("select 'line' as feature, 1.0::double as importance union all select 'order', 0.0")
def saved_model_importances(s, d):
    where = _folder(s)
    L.save_model(L.train_decision_tree(_lines(s, d)), where)
    return rounded(L.saved_importances(s, where, ["line", "order"]))


@query(f"with {I.SQL_POINTS} select count(*) as n, 0 as differ from pts")
def svd_pca_agreement(s, d):
    """Scores by singular vectors equal those by principal axes."""
    apart = F.exists(F.zip_with("pca", "svd", lambda a, b: F.abs(a - b) > 1e-6), lambda x: x)
    return L.svd_scores(I.points(s, d)).agg(F.count("*").alias("n"), F.count_if(apart).cast("int").alias("differ"))


@query()
def svd_scores(s, d):
    return L.svd_scores(I.points(s, d))


@query()
def components_sweep(s, d):
    return rounded(L.optimize_components(I.points(s, d)), 4)


@query()
def gmm_best(s, d):
    """Labels and probabilities of the mixture with the lowest BIC."""
    points = I.scores(s, d)
    best = L.select_gmm(L.gmm_sweep(points)).first()
    return L.gmm_labels(points, best.k, best.covariance)


@query()
def spectral_sweep(s, d):
    """Of standardised scores, as the reference clusters them."""
    return rounded(L.spectral_sweep(L.standardize(I.scores(s, d))), 4)


@query()
def hdbscan_sweep(s, d):
    """Of standardised scores, as the reference clusters them."""
    return rounded(L.hdbscan_sweep(L.standardize(I.scores(s, d))), 4)


# Frames that plots read.


@query(f"with {I.SQL_LONG} select series, date, round(value, 6) as value from m where series in ('gdp', 'cpi')")
def series_sample(s, d):
    return rounded(V.series_sample(I.gapped(s, d), ["gdp", "nothing", "cpi"]))


@query(
    """with e as (select event_type as series, value from events), f as (select series || t as series, value from e cross join (values (''), ('_d1'), ('_d2'), ('_d3')) x(t)),
 few as (select distinct series from f where not regexp_matches(series, '_d[23]$') order by series limit 20), k as (select * from f where value is not null and series in (select series from few)),
 sp as (select series, min(value) as lo, max(value) as hi, count(*) as total from k group by 1),
 b as (select series, cast(case when hi = lo then 1 else least(floor((value - lo) * 30 / (hi - lo)) + 1, 30) end as int) as bin, lo, hi, total, count(*) as n from k join sp using (series) group by all)
 select series, bin, round(lo + (bin - 1) * ((hi - lo) / 30), 6) as low, n, round(n / nullif(total * ((hi - lo) / 30), 0), 6) as density from b"""
)
def feature_distributions(s, d):
    e = I.read(s, d, "events").select(F.col("event_type").alias("series"), "value")
    tails = F.explode(F.array(*map(F.lit, ("", "_d1", "_d2", "_d3"))))
    return rounded(V.feature_distributions(e.withColumn("t", tails).select(F.concat("series", "t").alias("series"), "value")))


@query()
def pair_frame(s, d):
    """Scores on the first five principal axes, with the regime's name where it has one."""
    p = I.points(s, d)
    names = s.createDataFrame([(0, "first")], "label int, name string")
    return rounded(V.pair_frame(I.scores(s, d).select("id", "x"), p.filter("id % 7 <> 0").select("id", F.col("label").cast("int").alias("label")), names), 4)


@query()
def pca_scatter(s, d):
    """PC1 to PC4 with the regime."""
    p = I.points(s, d)
    scores = L.pca(p.select("id", "x"), 4)
    return rounded(V.pair_frame(scores, p.select("id", F.col("label").cast("int").alias("label")), s.createDataFrame([], "label int, name string"), 4), 4)
