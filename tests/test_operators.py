"""Operators on small frames against numpy and by their properties."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import sources
from tidemark.operators import checkpoints, density, features, hierarchy, learn, metrics, portfolio, regimes, series

from . import plain


def quarters(n, start=2000):
    out = []
    for k in range(n):
        y, q = start + k // 4, k % 4
        month = 3 * q + 3
        out.append(dt.date(y, month, {3: 31, 6: 30, 9: 30, 12: 31}[month]))
    return out


def long_frame(spark, values, name="x", dates=None):
    return spark.createDataFrame([(name, d, None if v is None else float(v)) for d, v in zip(dates or quarters(len(values)), values)], "series string, date date, value double")


def column(df, name="value"):
    return [r[name] for r in df.orderBy("series", "date").collect()]


def test_resample_and_densify(spark):
    rows = [("a", dt.date(2020, 1, 31), 1.0), ("a", dt.date(2020, 3, 1), 2.0), ("a", dt.date(2020, 3, 2), None), ("a", dt.date(2020, 8, 1), 5.0), ("b", dt.date(2020, 2, 1), float("nan"))]
    df = spark.createDataFrame(rows, "series string, date date, value double").withColumn("value", fn.known(F.col("value")))
    out = series.densify(series.resample_last(df)).orderBy("date").collect()
    assert [(r.series, r.date, r.value) for r in out] == [("a", dt.date(2020, 3, 31), 2.0), ("a", dt.date(2020, 6, 30), None), ("a", dt.date(2020, 9, 30), 5.0)]


def test_pct_change_pads(spark):
    df = long_frame(spark, [100, None, 110])
    assert column(series.pct_change(df)) == [None, 0.0, pytest.approx(0.1)]
    assert column(series.pct_change(df, pad=False)) == [None, None, None]


def numpy_derivatives(values, days, window, center):
    def smooth(x):
        a, b = series.bounds(window, center)
        return np.array([x[max(0, i + a) : i + b + 1].mean() for i in range(len(x))])

    out, s = [], smooth(np.array(values, float))
    for _ in range(3):
        s = smooth(np.gradient(s, days))
        out.append(s)
    return out


@pytest.mark.parametrize("center", [True, False])
def test_derivatives_match_numpy(spark, center):
    rng = np.random.default_rng(0)
    values, dates = rng.uniform(1, 9, 25), quarters(25)
    got = series.derivatives(long_frame(spark, values), 5, causal=not center)
    days = np.array([(d - dates[0]).days for d in dates], float)
    for name, want in zip(("d1", "d2", "d3"), numpy_derivatives(values, days, 5, center)):
        assert np.allclose(column(got, name), want, rtol=1e-8, atol=1e-15)


def test_strict_derivatives_never_look_ahead(spark):
    a = list(np.linspace(1, 5, 20))
    b = a[:15] + [99.0] * 5
    one, two = (series.derivatives(long_frame(spark, v), 5, strict=True) for v in (a, b))
    for c in ("d1", "d2", "d3"):
        assert column(one, c)[:15] == column(two, c)[:15]


def test_line_has_constant_slope_and_single_row_has_none(spark):
    dates = [dt.date(2000, 1, 1) + dt.timedelta(days=10 * k) for k in range(20)]
    d1 = column(series.derivatives(long_frame(spark, np.arange(20) * 2.0, dates=dates), 1), "d1")
    assert np.allclose(d1, 0.2)
    assert column(series.derivatives(long_frame(spark, [3.0])), "d1") == [None]


def test_gap_fill(spark):
    values = [None, 2, 3, None, None, 6, 7, 8, 9, 10, 11, 12, None]
    dates = [dt.date(2000, 1, 1) + dt.timedelta(days=90 * k) for k in range(13)]
    out = column(series.gap_fill(long_frame(spark, values, dates=dates)))
    assert all(v is not None for v in out) and np.allclose(out[1:-1], np.arange(2, 13), atol=0.1) and np.allclose(out, np.arange(1, 14), atol=0.6)
    assert [o for o, v in zip(out, values) if v is not None] == [v for v in values if v is not None]
    assert column(series.gap_fill(long_frame(spark, [None, None, None]))) == [None] * 3


def test_gap_fill_leaves_label_gaps(spark):
    df = long_frame(spark, [1, 2, None, 4, 5, 6]).withColumn("market_code", F.when(F.month("date") != 3, 1))
    out = series.gap_fill(df)
    assert out.filter("market_code is null").count() == df.filter("market_code is null").count()


def test_trim_tail_and_selection(spark):
    wide = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, 1.0, 1.0), (4, None, None)], "date int, a double, b double")
    assert [r.date for r in series.trim_tail(wide).orderBy("date").collect()] == [1, 2, 3]
    assert series.trim_tail(wide.filter("a is null")).count() == 2 and series.trim_tail(wide, enabled=False).count() == 4
    assert features.select_features(wide, ["b", "zz"]).columns == ["date", "b"]
    assert features.drop_columns_with_nulls(wide.filter("date = 2")).columns == ["date", "b"]


def test_ratios_logs_and_parsing(spark):
    logs = features.log_transforms(spark.createDataFrame([(-5.0,), (0.0,), (1.0,), (None,)], "x double"), ["x", "y"])
    got = [r.log_x for r in logs.collect()]
    assert got[:3] == pytest.approx([math.log(1e-9), math.log(1e-9), 0.0]) and got[3] is None
    rows = [("3,200.50", "num"), ("5.5%", "percent"), ("330 million", "million"), ("21.5 trillion", "trillion"), ("", "num"), ("n/a", "num"), (None, "num")]
    parsed = spark.createDataFrame(rows, "r string, k string").select(fn.parse_number(F.col("r"), F.col("k")).alias("v")).collect()
    assert [r.v for r in parsed] == [3200.5, 0.055, 330.0, 21.5, None, None, None]


def test_scrape(spark):
    html = "<table><tr><th>Date</th><th>Value</th></tr><tr class='o'><td>Jan 31, 2020</td><td><b> 3,200.50 </b></td></tr><tr><td>Feb 3, 2020</td><td>4%</td></tr></table>"
    raw = sources.scrape(spark.createDataFrame([("s", html), ("t", None)], "series string, html string"))
    assert {(r.raw_date, r.raw_value) for r in raw.collect()} == {("Jan 31, 2020", "3,200.50"), ("Feb 3, 2020", "4%")}
    out = sources.typed(raw.withColumn("kind", F.lit("percent"))).collect()
    assert [(r.date, r.value) for r in out] == [(dt.date(2020, 3, 31), 0.04)]


def label_frame(spark, ids):
    return spark.createDataFrame(list(zip(quarters(len(ids)), ids)), "date date, label int")


def test_transitions(spark):
    labels = label_frame(spark, [0, 1, 0, 1, 0, 2, 1, 2, 0, 1])
    rows = regimes.transition_matrix(labels).collect()
    assert len(rows) == 9
    for k in range(3):
        assert sum(r.prob for r in rows if r.from_label == k) == pytest.approx(1)
    ahead = {(r.from_label, r.to_label): r.prob for r in regimes.forward_probabilities(labels, 1).collect()}
    assert all(ahead[r.from_label, r.to_label] == pytest.approx(r.prob) for r in rows)
    assert sum(r.prob for r in regimes.transition_matrix(label_frame(spark, [0, 1])).collect() if r.from_label == 1) == 0


def test_names(spark):
    feats = long_frame(spark, [1, 1, 1, 9], "us_infl").unionByName(long_frame(spark, [5, 5, 5, 1], "gdp_growth"))
    names = {r.label: r.name for r in regimes.suggest_names(feats, label_frame(spark, [0, 0, 0, 1])).collect()}
    assert names == {0: "Regime 0", 1: "High Inflation / Weak/Neg Growth"}


def test_returns_and_portfolio(spark):
    x = [0.10, -0.2, 0.15, 0.12, 0.11]
    rows = long_frame(spark, x, "A").unionByName(long_frame(spark, [0.5] * 5, "B"))
    labels = label_frame(spark, [0, 1, 0, 0, 0])
    stats = portfolio.return_stats(rows, labels)
    got = {(r.label, r.asset): (r.median, r.hit_rate, r.n) for r in stats.collect()}
    assert got[0, "A"] == (pytest.approx(0.115), 1.0, 4) and got[1, "A"] == (-0.2, 0.0, 1)
    ranked = portfolio.rank_assets(stats)
    assert {r.asset: r.signal for r in portfolio.asset_signals(ranked, 1).collect()} == {"B": "GREEN", "A": "RED"}
    weights = portfolio.blended_portfolio(ranked, spark.createDataFrame([(0, 0.5), (1, 0.5), (2, 0.0)], "label int, prob double"), 1)
    assert {r.asset: r.weight for r in weights.collect()} == {"B": 1.0}
    trades = portfolio.recommendation(weights, spark.createDataFrame([("C", 1.0)], "asset string, weight double"))
    assert {r.asset: r.signal for r in trades.collect()} == {"B": "BUY", "C": "SELL"}
    assert portfolio.recommendation(weights).first().signal == "BUY" and portfolio.simple_portfolio(ranked, 9).count() == 0


def blobs(spark, k=3, n=20, spread=0.2, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0], [6, 0], [0, 6], [6, 6]])[:k]
    x = np.concatenate([c + spread * rng.standard_normal((n, 2)) for c in centers])
    rows = [(i, int(i // n), v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, label int, x array<double>"), x


def test_metrics_match_numpy(spark):
    points, x = blobs(spark)
    y = np.repeat(range(3), 20)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(60):
        a = d[i][y == y[i]].sum() / 19
        b = min(d[i][y == k].mean() for k in range(3) if k != y[i])
        s.append((b - a) / max(a, b))
    got = [r.s for r in metrics.silhouettes(points).orderBy("id").collect()]
    assert np.allclose(got, s)
    c = np.array([x[y == k].mean(0) for k in range(3)])
    w = ((x - c[y]) ** 2).sum()
    b = (20 * (c - x.mean(0)) ** 2).sum()
    assert metrics.inertia(points).first()[0] == pytest.approx(w)
    assert metrics.calinski_harabasz(points).first()[0] == pytest.approx(b * 57 / (w * 2))


def test_rand_index(spark):
    rows = [(i, m, k) for m, ids in (("a", [0] * 25 + [1] * 25), ("b", [1] * 25 + [0] * 25), ("n", [0] * 20 + [-1] * 10 + [1] * 20)) for i, k in enumerate(ids)]
    got = {(r.a, r.b): r.ari for r in metrics.rand_index(spark.createDataFrame(rows, "id long, method string, label int")).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["a", "a"] == 1 and got["a", "n"] == got["n", "a"]


def test_dbscan(spark):
    points, _ = blobs(spark)
    far = spark.createDataFrame([(99, 0, [50.0, 50.0])], points.schema)
    out = {r.id: r.label for r in density.dbscan(points.unionByName(far), 1.0, 5).collect()}
    assert out[99] == -1 and [len({out[i] for i in range(k, k + 20)}) for k in (0, 20, 40)] == [1, 1, 1] and len(set(out.values())) == 4
    assert [r.d for r in density.knn_distances(points, 1).collect()] == [0.0] * 60


def test_balanced_assignment_is_optimal():
    rng = np.random.default_rng(1)
    from itertools import product

    for _ in range(10):
        cost = rng.random((6, 3))
        got = plain.balanced_assignment(cost, 2, 2)
        assert sorted(np.bincount(got, minlength=3)) == [2, 2, 2]
        best = min(sum(cost[i, k] for i, k in enumerate(p)) for p in product(range(3), repeat=6) if all(p.count(k) == 2 for k in range(3)))
        assert cost[np.arange(6), got].sum() == pytest.approx(best)


def test_models(spark):
    points, x = blobs(spark, 3, 20)
    assert sorted(r.n for r in learn.balanced_kmeans(points, 3, 2).groupBy("label").agg(F.count("*").alias("n")).collect()) == [20, 20, 20]
    best = learn.select_gmm(learn.gmm_sweep(points, range(2, 5), ("diag", "full"), 2)).first()
    assert best.k == 3
    gap = learn.gap_statistic(points, range(2, 6), 5, 3).collect()
    assert sum(r.optimal for r in gap) == 1 and [r.k for r in gap if r.optimal] == [3] and all(r.gap_sk >= r.gap_std for r in gap)
    for found in (learn.spectral(points, 3, 10, 5), hierarchy.hdbscan(points, 5), learn.kmeans(points.select("id", "x"), 3, 3)):
        assert metrics.rand_index(found.select("id", F.lit("a").alias("method"), "label").unionByName(points.select("id", F.lit("b").alias("method"), "label"))).filter("a = 'a' and b = 'b'").first().ari == pytest.approx(1)
    z = learn.standardize(points.select("id", "x"))
    assert z.agg(F.stddev_pop(F.col("x")[0])).first()[0] == pytest.approx(1)


def test_classifier(spark):
    rng = np.random.default_rng(2)
    x = rng.random((60, 3))
    rows = [(d, v.tolist(), int(v[0] > 0.5)) for d, v in zip(quarters(60), x)]
    df = spark.createDataFrame(rows, "date date, x array<double>, label int")
    model = learn.train_classifier(df, "dt", depth=3)
    assert learn.predict(model, df).agg(F.avg((F.col("predicted") == F.col("label")).cast("int"))).first()[0] > 0.95
    assert learn.importances(model, ["a", "b", "c"], spark).first().feature == "a"
    assert learn.predict_current(model, df).agg(F.sum("prob")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        learn.train_classifier(df, "svm")
    with pytest.raises(ValueError):
        learn.importances(model, ["a"], spark)
    assert learn.forward_targets(df, 4, 1).count() == 56


def test_checkpoints(spark, tmp_path):
    c = checkpoints.Checkpoints(spark, f"file://{tmp_path}/c", "settings")
    assert c.list() == [] and not c.is_fresh("a")
    with pytest.raises(FileNotFoundError):
        c.load("a")
    df = long_frame(spark, range(20))
    meta = c.save(df, "a")
    assert meta["rows"] == 20 and meta["index_start"] == "2000-03-31" and c.load("a").count() == 20
    assert c.is_fresh("a") and not c.is_fresh("a", -1) and c.is_fresh("a", 7, True)
    assert not checkpoints.Checkpoints(spark, f"file://{tmp_path}/c", "other").is_fresh("a", 7, True)
    c.save(df, "b")
    assert [m["name"] for m in c.list()] == ["a", "b"]
    c.clear("a")
    assert [m["name"] for m in c.list()] == ["b"]
    c.clear_all()
    assert c.list() == []
    for day, n in (("2024-01-01", 3), ("2024-01-02", 5), ("2024-01-01", 4)):
        c.save_snapshot(df.limit(n), "s", day)
    assert c.load_snapshot("s", "2024-01-01").count() == 4 and c.load_snapshot("s", "2024-01-02").count() == 5


def test_sources(spark, tmp_path):
    made = []
    path = f"file://{tmp_path}/t"
    for _ in range(2):
        assert sources.parquet_or(spark, path, lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1
    assert sources.first_with_rows(lambda: None, lambda: spark.range(0), lambda: spark.range(2)).count() == 2

    def fetch(name):
        if name == "bad":
            raise OSError
        return [(dt.date(2020, 1, 1), 1.5)]

    sources.register_fetcher(spark, "fetched_series", fetch)
    assert [(r.series, r.value) for r in spark.read.format("fetched_series").option("series", "a,bad").load().collect()] == [("a", 1.5)]
    assert sources.name_overrides(f"{tmp_path}/none.yaml") == {}
    (tmp_path / "n.yaml").write_text("0: Calm\n_note: x\n'3': Storm\n")
    assert sources.name_overrides(f"{tmp_path}/n.yaml") == {0: "Calm", 3: "Storm"}


def test_streaming(spark, tmp_path):
    from tidemark.streaming import latest, quarterly_last

    rows = spark.createDataFrame([("a", dt.datetime(2020, 1, 5), 1.0), ("a", dt.datetime(2020, 3, 30), 2.0), ("a", dt.datetime(2020, 5, 1), 3.0)], "series string, ts timestamp, value double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = quarterly_last(stream).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.date, r.value) for r in latest(spark.table("days")).collect()} == {(dt.date(2020, 3, 31), 2.0), (dt.date(2020, 6, 30), 3.0)}
