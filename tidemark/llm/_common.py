"""Helpers shared by the training-data operators."""
from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every operator of this package.
WHITE = b" \t\n\x0b\x0c\r"
#: Rows that Spark hands to Python at once; texts may be long, so batches are kept small.
BATCH_ROWS = 1000
#: Bytes of text that one step of a batch loop holds at once.
SLICE_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did (a cluster installs it or uses --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the frame holds.

    An exact match wins over one that differs in case, the first of equal names over later ones, so extra columns with
    clashing names do no harm.
    """
    found = []
    for name in names:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not exact and not loose:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        found.append((exact or loose)[0])
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(n) for i, n in zip(found, names)))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches; ``fn`` must not depend on where batches are cut."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))
    return df.mapInArrow(fn, schema)


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = size = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if i > at and size + (n or 0) > most:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        yield batch.slice(at)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lowest(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``df`` with ``h``, a hash of ``keys``, less rows that cannot be among the ``most`` of lowest hash.

    A sample for training takes the lowest hashes of ``df``, which comes with the sample's filters applied. Rows are counted by
    the high bits of the hash (65,536 numbers at most); the bound is the end of the class where the count reaches ``most``, so
    what tasks send on does not grow with the input, and no row of the sample is lost, however often a hash repeats.
    """
    h = df.withColumn("h", F.xxhash64(*keys))
    total = 0
    for r in sorted(h.groupBy(F.shiftright("h", 48).alias("high")).count().collect(), key=lambda r: r["high"]):
        total += r["count"]
        if total >= most:
            return h.filter(F.col("h") < F.lit((r["high"] + 1) << 48)) if r["high"] < 2**15 - 1 else h
    return h


def labelled(docs: DataFrame, labels: DataFrame, label: str, learnt: Callable[[], Column], sample: int, most_chars: int) -> list[tuple[str, int]]:
    """At most ``sample`` texts of each value (0, 1) of ``label``, of rows that ``learnt`` takes: those of the lowest hash of doc_id.

    A doc_id with several labels counts as 1. Texts that are null or longer than ``most_chars`` are no samples.
    """
    known = pick(labels, "doc_id", label).filter("doc_id is not null").filter(F.col(label).isin(0, 1)).filter(learnt())
    one = known.groupBy("doc_id").agg(F.max(label).alias(label))
    rows = pick(docs, "doc_id", "text").filter("doc_id is not null and text is not null").filter(F.length("text") <= most_chars)
    out = []
    for value in (0, 1):
        some = lowest(one.filter(F.col(label) == value), ["doc_id"], 2 * sample).orderBy("h", "doc_id").limit(2 * sample)  # some have texts that are too long
        found = rows.join(F.broadcast(some), "doc_id").orderBy("h", "doc_id", "text").limit(sample).select("text").collect()
        out += [(r.text, value) for r in found]
    return out


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where it is unset, only a local session has one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{os.path.abspath('spark-warehouse')}/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, which also cuts the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
