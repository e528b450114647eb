"""The steps end to end on made-up series."""
import datetime as dt

import numpy as np
import pytest

from tidemark.operators import reports
from tidemark.plans.run import STEPS, Run, Settings, parser

from .test_operators import long_frame, quarters


def test_all_steps(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 48
    regime = np.repeat([0, 1, 0, 1, 0, 1], 8)
    series = {k: 50 + 10 * regime + rng.normal(0, 1, n) for k in ("sp500", "sp500_adj", "dividend", "gdp", "fred_gdp", "fred_gnp", "cpi", "fred_cpi", "fred_baa", "fred_aaa", "us_infl")}
    series["div_yield"] = 0.02 + 0.01 * regime
    df = None
    for name, values in series.items():
        one = long_frame(spark, [None if name == "cpi" and k in (5, 6) else v for k, v in enumerate(values)], name)
        df = one if df is None else df.unionByName(one)
    names = ["log_sp500", "us_infl", "cpi", "gdp"]
    settings = Settings(logs=["sp500"], initial=names, final=[*names, "us_infl_d1"], components=2, ks=(2, 3), k_cap=2, trees=5, horizons=(1,))
    run = Run(spark, f"file://{tmp_path}/run", settings)
    run.ingest(df)
    run.features()
    run.cluster()
    labels = {r.date: r.label for r in run.labels("clustered").collect()}
    got = [labels[d] for d in quarters(n)]
    assert np.mean(np.array(got) == regime) > 0.85 or np.mean(np.array(got) != regime) > 0.85
    run.regimes()
    run.predict()
    run.returns()
    text = run.report(spark.createDataFrame([("sp500", 1.0)], "asset string, weight double"))
    assert "Current regime" in text and "Next quarter" in text
    csv = spark.read.option("header", True).csv(f"file://{tmp_path}/run/reports/recommendations")
    assert csv.columns == ["asset", "current_pct", "target_pct", "delta_pct", "signal"] and csv.count() >= 1
    assert {m["name"] for m in run.kept.list()} >= {"macro_long", "features", "features_supervised", "pca", "kmeans_scores", "profiles", "transition_matrix", "returns", "return_stats"}


def test_parser_and_validation(spark):
    a = parser().parse_args(["--folder", "f", "--config", "c"])
    assert a.steps.split(",") == list(STEPS) and a.source == "clustered"
    df = spark.createDataFrame([(dt.date(2020, 3, 31), None)], "date date, x double")
    with pytest.raises(ValueError):
        reports.validate(df)
    assert reports.validate(df, 1, ["date"]).count() == 1
