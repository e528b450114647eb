"""Exact quantiles over ranges against numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import stats


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_against_numpy(spark, parts):
    rng = np.random.default_rng(parts)
    groups = {"hot": np.concatenate([np.full(400, 1.5), rng.normal(size=800)]), None: rng.integers(0, 5, 33).astype(float), "one": np.array([-3.25]), "copies": np.full(50, 7.0)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("empty", None)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    df = spark.createDataFrame(rows, "series string, value double").repartition(parts)
    got = {r.series: r.q for r in stats.quantiles(df, ["series"], shares).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose(got[g], np.quantile(values, shares), rtol=1e-12, atol=1e-12)
    summary = {r.series: r for r in stats.describe(df).collect()}
    assert set(summary) == {*groups, "empty"} and summary["empty"].q50 is None and summary["empty"].n == 0
    assert summary["hot"].q75 == pytest.approx(np.quantile(groups["hot"], 0.75)) and summary[None].n == 33


def test_no_values(spark):
    empty = spark.createDataFrame([], "series string, value double")
    assert stats.quantiles(empty, ["series"], [0.5]).count() == 0 and stats.describe(empty).count() == 0
    both = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("a", 1, 3.0)], "series string, label int, value double")
    assert {(r.series, r.label): r.q for r in stats.quantiles(both, ["label", "series"], [0.5]).collect()} == {("a", 1): [2.5], ("a", 2): [4.0]}
    assert both.select(F.max("value")).first()[0] == 4.0
