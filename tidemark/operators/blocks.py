"""Work over pairs of points in blocks of fixed size, and row numbers without a single partition.

Pairs are never rows: a task holds two blocks and returns what is summed or chosen from their distances, so memory is bounded
and any number of points is taken; the work is that of all pairs, or of those in neighbouring cells.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship

#: Bytes of differences that a task holds at once; for few coordinates as many as stay in a core's cache.
STEP_BYTES, NEAR_BYTES = 32 << 20, 1 << 18
#: Links that one task joins.
LAST = 1 << 18


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, from differences, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    if 0 < a.shape[1] < 8:  # so few squares are added in order either way, so coordinate by coordinate the sums are the same
        step = max(1, NEAR_BYTES // (8 * max(1, len(b))))
        cols, held = np.ascontiguousarray(b.T), np.empty((step, len(b)))
        for at in range(0, len(a), step):
            sums, own = out[at : at + step], a[at : at + step]
            d = held[: len(own)]
            for j, c in enumerate(cols):
                to = d if j else sums
                np.subtract(own[:, j, None], c, out=to)
                np.multiply(to, to, out=to)
                if j:
                    sums += d
            np.sqrt(sums, out=sums)
        return out
    step = max(1, STEP_BYTES // (8 * max(1, b.size)))
    for at in range(0, len(a), step):
        out[at : at + step] = np.sqrt(((a[at : at + step, None] - b[None]) ** 2).sum(2))
    return out


def rough(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a product of matrices, and by how much rounding may have changed any of them."""
    origin = a.mean(0) if len(a) else 0.0
    a, b = a - origin, b - origin
    na, nb = (a * a).sum(1), (b * b).sum(1)
    one = np.ones((1, len(a))), np.ones((1, len(b)))
    d = np.concatenate([a.T, na[None], one[0]]).T @ np.concatenate([-2 * b.T, one[1], nb[None]])
    return d, 1e-15 * (a.shape[1] + 8) * float(na.max(initial=0) + nb.max(initial=0))


def of_pairs(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``distances`` of some pairs."""
    out = np.empty(len(at))
    step = max(1, NEAR_BYTES // (8 * max(1, a.shape[1])))
    for i in range(0, len(at), step):
        out[i : i + step] = np.sqrt(((a[at[i : i + step]] - b[to[i : i + step]]) ** 2).sum(1))
    return out


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """``distances(a, b) <= eps``; only pairs that a product of matrices leaves in doubt are told by differences."""
    d, slack = rough(a, b)
    slack += 1e-14 * eps * eps
    near, may = d < eps * eps - slack, d <= eps * eps + slack
    n = np.count_nonzero(may) - np.count_nonzero(near)
    if n > d.size // 16:
        return distances(a, b) <= eps
    if n:
        at, to = np.nonzero(may != near)
        near[at, to] = of_pairs(a, b, at, to) <= eps
    return near


def quick(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, to eight digits or more; pairs so near that a product of matrices would tell fewer are told by differences."""
    d, slack = rough(a, b)
    doubt = d <= 1e8 * slack
    n = np.count_nonzero(doubt)
    if n > d.size // 16:
        return distances(a, b)
    at, to = np.nonzero(doubt) if n else (np.zeros(0, int), np.zeros(0, int))
    d[at, to] = 0
    np.sqrt(d, out=d)
    d[at, to] = of_pairs(a, b, at, to)
    return d


def nested(a: np.ndarray, b: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, distances over so many of the first coordinates), ascending; sums go on from one width to the next."""
    if widths == [a.shape[1]]:
        yield a.shape[1], quick(a, b)
        return
    sums, at = np.zeros((len(a), len(b))), 0
    for width in widths:
        for j in range(at, width):
            d = a[:, j, None] - b[:, j]
            d *= d
            sums += d
        at = width
        yield width, np.sqrt(sums)


def numbered(df: DataFrame, *order: str, name: str = "_rn") -> DataFrame:
    """``df`` with each row's place in ``order``, from 0: rows are dealt out by ranges and counted partition by partition."""
    ensure_checkpoint_dir(df.sparkSession)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Ranges are drawn anew each time a plan runs, so places are taken from one run.
    rows = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)).checkpoint()
    counts = {r._part: r.n for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    begins, at = [], 0
    for k in sorted(counts):
        begins.append((k, at))
        at += counts[k]
    first = df.sparkSession.createDataFrame(begins, "_part int, _first long")
    return rows.join(F.broadcast(first), "_part").withColumn(name, F.col("_at") + F.col("_first")).drop("_part", "_at", "_first")


def placed_by(df: DataFrame, weight: str, *order: str) -> DataFrame:
    """``df`` with ``_before``: the sum of ``weight`` over all rows before in ``order``. Dealt and counted as in ``numbered``."""
    ensure_checkpoint_dir(df.sparkSession)
    ship(df.sparkSession)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                own = batch.column(weight).to_numpy()
                after = total + np.cumsum(own)
                total = int(after[-1])
                yield batch.append_column("_before", pa.array(after - own))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    rows = dealt.mapInArrow(run, f"{kinds}, _before long").checkpoint()
    sums = {r._part: r.n for r in rows.groupBy("_part").agg(F.sum(weight).alias("n")).collect()}  # a row a partition
    begins, at = [], 0
    for k in sorted(sums):
        begins.append((k, at))
        at += sums[k]
    first = df.sparkSession.createDataFrame(begins, "_part int, _first long")
    return rows.join(F.broadcast(first), "_part").withColumn("_before", F.col("_before") + F.col("_first")).drop("_part", "_first")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(up.setdefault(a, a)), find(up.setdefault(b, b))
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(up, pa.int64()), pa.array([find(i) for i in up], pa.int64())], names=["id", "root"])


def components(links: DataFrame, last: int = LAST) -> DataFrame:
    """(id, root) of every end of ``links`` (a, b): the smallest id that it reaches. A table of its own, in the checkpoint folder.

    Each round lowers roots to the smallest next to a node, then to the root of the root, and parts links between roots that
    still differ from the others; once these are ``last`` at most, one task joins them. Nothing comes to the driver but counts.
    """
    ship(links.sparkSession)
    ensure_checkpoint_dir(links.sparkSession)
    open_ = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    roots = None  # of all ids so far; those of open links are ids themselves
    while True:
        if open_.count() <= last:
            step = open_.coalesce(1).mapInArrow(_joined, "id long, root long")
            return (step if roots is None else _led(roots, step)).checkpoint()
        # Every node hangs on the smallest next to it; what hangs on a root's root follows.
        both = open_.select("a", "b").unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("root")).checkpoint()
        step = _led(_led(near, near), near).checkpoint()
        roots = step if roots is None else _led(roots, step).checkpoint()
        for c in ("a", "b"):
            open_ = open_.join(step.withColumnRenamed("id", c), c).drop(c).withColumnRenamed("root", c)
        open_ = open_.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()


def _led(roots: DataFrame, step: DataFrame) -> DataFrame:
    """``roots`` led on by ``step`` where it knows the root."""
    return roots.join(step.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
