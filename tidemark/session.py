"""Session settings that the operators count on."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; keyword names have underscores for dots."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did (a cluster installs it or uses --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that spark.checkpoint.dir names; where it is unset, only a local session has one of its own."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{os.path.abspath('spark-warehouse')}/checkpoints"
    spark.sparkContext.setCheckpointDir(where)
