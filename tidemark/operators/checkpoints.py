"""Named Parquet tables with a manifest beside them, in any store that Spark can reach.

A table is saved as a new version in a folder of its own; then the manifest, which names the version, takes the place of the
old one in one step. Readers follow the manifest, so a save that fails half way leaves the old table as it was.
"""
from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Checkpoints:
    """Tables under one folder. Manifests are one-line text files, read and written through Spark's own file system."""

    def __init__(self, spark: SparkSession, folder: str, config_text: str = ""):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.config_hash = hashlib.md5(config_text.encode()).hexdigest()[:8]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str, index: str = "date") -> dict:
        """Write a new version, count once over what was written, then let the manifest name it. Older versions go, but for the
        last one, which readers may still be at."""
        before = self.meta(name) or {}
        version = f"{name}.versions/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{version}")
        kept = self.spark.read.parquet(f"{self.folder}/{version}")
        ends = [F.min(index).cast("string").alias("a"), F.max(index).cast("string").alias("b")] if index in kept.columns else [F.lit(None).alias("a"), F.lit(None).alias("b")]
        row = kept.agg(F.count("*").alias("n"), *ends).first()
        # The keys but the last are fixed values: readers of manifests know these names.
        meta = {"name": name, "created": datetime.now().isoformat(), "config_hash": self.config_hash, "rows": row.n, "columns": len(kept.columns), "col_names": kept.columns, "index_start": row.a, "index_end": row.b, "version": version}
        self._publish(name, meta)
        current = {version.rsplit("/", 1)[1], before.get("version", "").rsplit("/", 1)[-1]}
        for f in self._fs().listStatus(self._path(f"{name}.versions")):
            if f.getPath().getName() not in current:
                self._fs().delete(f.getPath(), True)
        return meta

    def _publish(self, name: str, meta: dict) -> None:
        """The manifest under another name first, then renamed over the old one."""
        draft, final = self._path(f"{name}.draft-{uuid.uuid4().hex}"), self._path(f"{name}.meta.json")
        out = self._fs().create(draft, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        over = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, over)

    def _table(self, name: str) -> str | None:
        """Where the table is: the version that the manifest names, or a folder of snapshots."""
        for place in ((self.meta(name) or {}).get("version"), f"{name}.parquet"):
            if place and self._fs().exists(self._path(place)):
                return f"{self.folder}/{place}"
        return None

    def load(self, name: str) -> DataFrame:
        where = self._table(name)
        if where is None:
            raise FileNotFoundError(f"{self.folder}/{name}")
        return self.spark.read.parquet(where)

    def save_snapshot(self, df: DataFrame, name: str, date: str) -> None:
        """The state of a table on a date; that date's rows alone are replaced."""
        rows = df.withColumn("snapshot_date", F.lit(date).cast("date"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(f"{self.folder}/{name}.parquet")

    def load_snapshot(self, name: str, date: str) -> DataFrame:
        """One partition is read."""
        return self.load(name).filter(F.col("snapshot_date") == F.lit(date).cast("date")).drop("snapshot_date")

    def meta(self, name: str) -> dict | None:
        """The manifest; None if it is missing or no JSON."""
        if not self._fs().exists(self._path(f"{name}.meta.json")):
            return None
        text = self.spark.read.text(f"{self.folder}/{name}.meta.json", wholetext=True).first()
        try:
            return json.loads(text[0]) if text else None
        except ValueError:
            return None

    def is_fresh(self, name: str, max_age_days: float = 7.0, require_config_match: bool = False) -> bool:
        meta = self.meta(name)
        if meta is None or self._table(name) is None:
            return False
        young = datetime.now() - datetime.fromisoformat(meta["created"]) <= timedelta(days=max_age_days)
        return young and (not require_config_match or meta.get("config_hash") == self.config_hash)

    def list(self) -> list[dict]:
        """Manifests by age; those that cannot be read are passed over."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not self._fs().exists(root):
            return []
        files = self._fs().listStatus(root)
        names = [f.getPath().getName() for f in files]
        found = [self.meta(n.removesuffix(".meta.json")) for n in names if n.endswith(".meta.json")]
        return sorted((m for m in found if m), key=lambda m: m["created"])

    def summary(self) -> DataFrame:
        """(name, created, shape, config_hash) of all that can be read, by age."""
        rows = [(m["name"], m["created"][:19], f"{m.get('rows', '?')}x{m.get('columns', '?')}", m.get("config_hash", "?")) for m in self.list()]
        return self.spark.createDataFrame(rows, "name string, created string, shape string, config_hash string")

    def save_both(self, df: DataFrame, name: str, index: str = "date") -> dict:
        """A table, and the same rows as CSV beside it for people."""
        meta = self.save(df, name, index)
        self.load(name).write.mode("overwrite").option("header", True).csv(f"{self.folder}/{name}.csv")
        return meta

    def clear(self, name: str) -> None:
        for tail in (".meta.json", ".versions", ".parquet", ".csv"):
            self._fs().delete(self._path(name + tail), True)

    def clear_all(self) -> None:
        for m in self.list():
            self.clear(m["name"])
