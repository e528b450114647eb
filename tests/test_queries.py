"""Every query with SQL against DuckDB on the smallest tables."""
import math
import os

import pytest

from tidemark.plans.queries import ORACLES, QUERIES, flagship

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def key(row):
    return tuple("" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    assert sorted(key(r[c] for c in cols) for r in df.collect()) == sorted(map(key, want.project(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_flagship(spark):
    assert flagship(spark, DATA).count() > 0


def test_one_shuffle_for_stacked_windows(spark):
    from tidemark.operators import series
    from tidemark.plans import inputs

    plan = series.derivatives(inputs.gapped(spark, DATA).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(series") == 1


def test_scan_reads_two_columns(spark):
    plan = QUERIES["value_counts_share"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan


@pytest.mark.parametrize(
    "name,operator,rows",
    [("kmeans_sweep", "kmeans_sweep", None), ("balanced_kmeans", "balanced_kmeans", None), ("dbscan_sweep", "dbscan_sweep", None), ("gmm_bic", "gmm_sweep", 24), ("gap_statistic", "gap_statistic", 10)],
)
def test_sweeps_run_whole_grids(spark, monkeypatch, name, operator, rows):
    from tidemark.plans import queries

    own, given = getattr(queries.L, operator), []

    def take(points, *a, **k):
        given.append((a, k))
        return own(points, *a, **k) if rows else points.select("id").withColumn("resp", points["id"])

    monkeypatch.setattr(queries.L, operator, take)
    out = QUERIES[name](spark, DATA)
    assert given == [((), {})]
    assert rows is None or out.count() == rows


def test_forests_have_default_trees(spark, monkeypatch):
    from tidemark.plans import queries

    own, given = queries.L.train_classifier, []

    def take(df, kind="rf", trees=200, depth=None, **k):
        given.append((trees, depth))
        return own(df, kind, 2, 2, **k)

    monkeypatch.setattr(queries.L, "train_classifier", take)
    QUERIES["rf_regime"](spark, DATA)
    assert given == [(200, None)]
    out = QUERIES["forward_rf"](spark, DATA)
    assert set(given[1:]) == {(200, 30)}
    assert {r.horizon for r in out.select("horizon").distinct().collect()} == {1, 2, 4, 8}


def test_models_cluster_scores_of_whole_vectors(spark, monkeypatch):
    from tidemark.plans import inputs, queries

    want = {r.id: [r[f"PC{k}"] for k in range(1, 6)] for r in QUERIES["pca_scores"](spark, DATA).collect()}
    got = {}
    monkeypatch.setattr(queries.H, "hdbscan", lambda points: got.update((r.id, r.x) for r in points.collect()) or points)
    QUERIES["hdbscan_labels"](spark, DATA)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-3) for i in want)
    assert QUERIES["svd_loadings"](spark, DATA).count() == 3 * len(inputs.points(spark, DATA).first().x)


def test_pair_frame_shows_scores(spark):
    want = {r.id: [r[f"PC{k}"] for k in range(1, 6)] for r in QUERIES["pca_scores"](spark, DATA).collect()}
    rows = QUERIES["pair_frame"](spark, DATA).collect()
    assert {r.id for r in rows} == want.keys() and all([r[f"PC{k}"] for k in range(1, 6)] == pytest.approx(want[r.id], abs=1e-3) for r in rows)
    assert {r.regime for r in rows if r.id % 7 == 0} == {"?"} and "first" in {r.regime for r in rows}
