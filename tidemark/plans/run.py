"""The steps from raw series to trades, each a checkpointed table or two: ``python -m tidemark.plans.run --help``.

Step 1 takes long series and quarterly labels from wherever ``sources`` read them; later steps read what earlier ones kept.
"""
from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import features as X
from ..operators import learn as L
from ..operators import metrics as M
from ..operators import portfolio as P
from ..operators import regimes as R
from ..operators import reports
from ..operators import series as S
from ..operators.checkpoints import Checkpoints


@dataclass(frozen=True)
class Settings:
    logs: list[str] = field(default_factory=list)
    initial: list[str] = field(default_factory=list)
    final: list[str] = field(default_factory=list)
    lagged: list[str] = field(default_factory=list)
    start: str = "1950-01-01"
    end: str | None = None
    components: int = 5
    ks: tuple[int, int] = (2, 12)
    k_cap: int = 5
    balanced: bool = True
    drop_incomplete_tail: bool = True
    strict: bool = False
    trees: int = 200
    horizons: tuple[int, ...] = (1, 2, 4, 8)
    green: float = 0.02
    yellow: float = 0.0
    top: int = 3
    threshold: float = 0.05
    max_age_days: float = 7.0
    refresh: bool = False


class Run:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings, names_file: str = ""):
        self.spark, self.folder, self.s, self.names_file = spark, folder.rstrip("/"), settings, names_file
        self.kept = Checkpoints(spark, f"{self.folder}/checkpoints", repr(settings))

    def _fresh(self, *names: str) -> bool:
        return not self.s.refresh and all(self.kept.is_fresh(n, self.s.max_age_days, True) for n in names)

    def ingest(self, series: DataFrame, labels: DataFrame | None = None) -> None:
        """Quarters of all series, some lagged by a quarter; labels by date beside them."""
        if self._fresh("macro_long"):
            return
        rows = S.densify(S.resample_last(series))
        late = F.col("series").isin(self.s.lagged)
        rows = rows.filter(~late).unionByName(S.lag(rows.filter(late))).filter(F.col("date") >= F.lit(self.s.start).cast("date"))
        if self.s.end:
            rows = rows.filter(F.col("date") <= F.lit(self.s.end).cast("date"))
        self.kept.save(rows, "macro_long")
        if labels is not None:
            self.kept.save(labels.select("date", F.col("label").cast("int").alias("label")), "market_code_given")

    def wide(self, label: str | None = None) -> DataFrame:
        rows = self.kept.load("macro_long")
        names = [r.series for r in rows.select("series").distinct().orderBy("series").collect()]
        out = S.widen(rows, names)
        return out if label is None else out.join(self.labels(label).withColumnRenamed("label", "market_code"), "date", "left")

    def labels(self, source: str) -> DataFrame:
        """``given``, ``clustered`` or ``predicted``."""
        return self.kept.load(f"market_code_{source}")

    def features(self) -> None:
        if self._fresh("features", "features_supervised"):
            return
        wide = self.wide()
        for name, causal in (("features", False), ("features_supervised", True)):
            out = X.engineer(wide, self.s.logs, self.s.initial, self.s.final, causal=causal, strict=self.s.strict and causal)
            self.kept.save(out, name)

    def points(self, name: str) -> DataFrame:
        """(id, date, x): dates whose features are all known, in the settings' order of features."""
        wide = S.widen(self.kept.load(name), self.s.final)
        if self.s.drop_incomplete_tail:
            wide = S.trim_tail(wide)
        whole = wide.dropna("any")
        return whole.select(F.datediff("date", F.lit("1900-01-01").cast("date")).cast("long").alias("id"), "date", F.array(*self.s.final).alias("x"))

    def cluster(self) -> None:
        if self._fresh("pca", "kmeans_scores", "market_code_clustered"):
            return
        points = self.points("features")
        n = min(self.s.components, len(self.s.final))
        scores = L.pca(points, n)
        self.kept.save(scores, "pca")
        scores = self.kept.load("pca")
        self.kept.save(L.kmeans_sweep(scores, range(self.s.ks[0], self.s.ks[1] + 1), 3), "kmeans_scores", "k")
        best = M.pick_k(self.kept.load("kmeans_scores"), self.s.k_cap).first().best_k
        found = L.balanced_kmeans(scores, best) if self.s.balanced else L.kmeans(scores, best)
        self.kept.save(scores.select("id", "date").join(found, "id").select("date", "label"), "market_code_clustered")

    def regimes(self, source: str = "clustered") -> None:
        feats, labels = self.kept.load("features"), self.labels(source)
        self.kept.save(R.profiles(feats, labels), "profiles")
        own = sources.name_overrides(self.names_file) if self.names_file else {}
        auto = R.suggest_names(feats, labels)
        given = self.spark.createDataFrame(list(own.items()), "label int, name string")
        self.kept.save(R.override_names(auto, given), "regime_names")
        self.kept.save(R.transition_matrix(labels), "transition_matrix")

    def predict(self, source: str = "clustered") -> None:
        rows = self.points("features_supervised").join(self.labels(source), "date").filter("label is not null")
        model = L.train_classifier(rows, "rf", trees=self.s.trees)
        L.save_model(model, f"{self.folder}/models/current")
        L.save_model(L.train_classifier(rows, "dt"), f"{self.folder}/models/tree")
        for h, by_label in L.train_forward(rows, self.s.horizons, self.s.trees).items():
            for k, m in by_label.items():
                L.save_model(m, f"{self.folder}/models/forward/h={h}/regime={k}")
        self.kept.save(L.predict(model, self.points("features_supervised")).select("date", F.col("predicted").alias("label")), "market_code_predicted")
        self.kept.save(L.importances(model, self.s.final, self.spark), "importances")

    def returns(self, prices: DataFrame | None = None, source: str = "clustered") -> None:
        """From prices; without any, from proxies among the series."""
        moved = P.quarterly_returns(prices) if prices is not None and prices.limit(1).count() else None
        if moved is None:
            wide = S.proxy_returns(self.wide(), ["sp500", "sp500_adj"], ["10yr_ustreas", "gdp_growth", "us_infl", "credit_spread"])
            moved = S.lengthen(wide)
        self.kept.save(moved, "returns")
        self.kept.save(P.return_stats(self.kept.load("returns"), self.labels(source)), "return_stats")

    def report(self, holdings: DataFrame | None = None) -> str:
        """Signals, two portfolios and trades as CSV; the dashboard as text."""
        points = self.points("features_supervised")
        now = L.predict_current(L.load_model(f"{self.folder}/models/current"), points)
        probs = now.select(F.col("label").cast("int").alias("label"), "prob")
        current = now.first().predicted
        ranked = P.rank_assets(self.kept.load("return_stats"))
        signals = P.asset_signals(ranked, current, self.s.green, self.s.yellow)
        blended = P.blended_portfolio(ranked, probs, self.s.top)
        trades = P.recommendation(blended, holdings, self.s.threshold)
        for name, df in (("dashboard", signals.orderBy("rank")), ("simple", P.simple_portfolio(ranked, current, self.s.top)), ("blended", blended), ("recommendations", trades.orderBy("asset"))):
            reports.write_csv(df, f"{self.folder}/reports/{name}")
        names = {r.label: r.name for r in self.kept.load("regime_names").collect()}
        return reports.dashboard(current, names, probs, self.kept.load("transition_matrix"), signals)


STEPS = ("ingest", "features", "cluster", "regimes", "predict", "returns", "report")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--folder", required=True, help="where tables, models and reports are kept")
    p.add_argument("--config", required=True, help="YAML with the fields of Settings")
    p.add_argument("--series", help="Parquet of (series, date, value), for ingest")
    p.add_argument("--labels", help="Parquet of (date, label), for ingest")
    p.add_argument("--prices", help="Parquet of (series, date, value), for returns")
    p.add_argument("--names", default="", help="YAML of regime names that win over suggested ones")
    p.add_argument("--source", default="clustered", choices=("given", "clustered", "predicted"), help="labels of steps 4 to 6")
    p.add_argument("--steps", default=",".join(STEPS))
    p.add_argument("--refresh", action="store_true", help="redo steps whose tables are fresh")
    p.add_argument("--keep-incomplete-tail", action="store_true")
    p.add_argument("--unbalanced", action="store_true", help="plain k-means")
    return p


def main(args: list[str] | None = None) -> None:
    from ..session import build

    a = parser().parse_args(args)
    spark = build()
    own = sources.config(a.config) | {"refresh": a.refresh} | ({"drop_incomplete_tail": False} if a.keep_incomplete_tail else {}) | ({"balanced": False} if a.unbalanced else {})
    run = Run(spark, a.folder, Settings(**own), a.names)
    read = lambda path: spark.read.parquet(path) if path else None
    do = {
        "ingest": lambda: run.ingest(read(a.series), read(a.labels)),
        "features": run.features,
        "cluster": run.cluster,
        "regimes": lambda: run.regimes(a.source),
        "predict": lambda: run.predict(a.source),
        "returns": lambda: run.returns(read(a.prices), a.source),
        "report": lambda: print(run.report()),
    }
    for step in [s for s in STEPS if s in a.steps.split(",")]:
        do[step]()


if __name__ == "__main__":
    main()
