"""Points in blocks of neighbours, which meet only where a bound allows it, without being sent to each other.

Every point goes to the nearest of some pivots; a pivot's points are a cell, and cells are dealt to blocks of bounded size. Of
each cell the widest distance to its pivot is known, and the least and the greatest distance to some pivots that all cells
share. By the triangle inequality these bound how near points of two cells can be, so blocks whose bound is above what is
looked for never meet. The bounds are a matrix over pivots, of which there are MOST_PIVOTS at most, whatever the input; with
more points a cell is more blocks.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship
from .blocks import distances

#: Points of a block, pivots at most, and those whose distances bound all cells.
BLOCK, MOST_PIVOTS, REFERENCES = 1024, 1024, 32
#: Bytes of other blocks that a task keeps at hand, and tasks a core for the blocks that meet them.
HELD, TASKS = 64 << 20, 8
#: Bounds are lowered by this share, so rounding loses no pair.
SLACK = 1e-9

Rows = dict[str, np.ndarray]


def columns(batch: pa.RecordBatch) -> Rows:
    """Columns as numpy arrays; x, whose rows have one length, as a matrix."""
    out = {}
    for name in batch.schema.names:
        c = batch.column(name)
        out[name] = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)
    return out


def batch_of(schema: str, *values: np.ndarray) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    arrow = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v, arrow[k]) for v, k in zip(values, kinds)], names=list(names))


class Bounds:
    """What is known of cells: their pivots, sizes and widths, and least and greatest distances to the references."""

    def __init__(self, pivots: np.ndarray, sizes: np.ndarray, wide: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.sizes, self.wide, self.low, self.high = pivots, sizes, wide, low, high
        lower = distances(pivots, pivots) - wide[:, None] - wide
        for j in range(low.shape[1]):
            lower = np.maximum(lower, np.maximum(low[:, None, j] - high[:, j], low[:, j] - high[:, None, j]))
        np.fill_diagonal(lower, 0)
        self.lower = np.maximum(lower, 0) * (1 - SLACK)
        self.lower[:, sizes == 0] = np.inf

    def beyond(self, x: np.ndarray, cell: int, alone: bool) -> np.ndarray:
        """How near a point of any other block may be at least; ``alone``: the block is its whole cell."""
        lower = distances(x, self.pivots) - self.wide
        d = distances(x, self.pivots[: self.low.shape[1]])
        for j in range(self.low.shape[1]):
            lower = np.maximum(lower, np.maximum(self.low[:, j] - d[:, [j]], d[:, [j]] - self.high[:, j]))
        lower = np.maximum(lower, 0) * (1 - SLACK)
        lower[:, self.sizes == 0] = np.inf
        if alone:
            lower[:, cell] = np.inf
        return lower.min(1)


class Placed:
    """``rows`` (block, cell, id, x, and what else the points had), ``blocks`` (cell, block), and the bounds of cells."""

    def __init__(self, points: DataFrame, block: int = BLOCK):
        ship(points.sparkSession)
        ensure_checkpoint_dir(points.sparkSession)
        own = points.checkpoint()
        n = own.count()
        if not n:
            raise ValueError("no points")
        found = own.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, -(-n // block))).collect()
        pivots = np.array([r.x for r in found], float)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = distances(columns(batch.select(["x"]))["x"], pivots)
                    yield batch.append_column("cell", pa.array(d.argmin(1), pa.int64()))

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape = (len(pivots), min(REFERENCES, len(pivots)))
            low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
            wide, count = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
            for batch in batches:
                if batch.num_rows:
                    rows = columns(batch)
                    d = distances(rows["x"], pivots)
                    np.minimum.at(low, rows["cell"], d[:, : shape[1]])
                    np.maximum.at(high, rows["cell"], d[:, : shape[1]])
                    np.maximum.at(wide, rows["cell"], d[np.arange(len(d)), rows["cell"]])
                    count += np.bincount(rows["cell"], minlength=len(pivots))
            some = np.flatnonzero(count)
            cell, ref = np.repeat(some, shape[1]), np.tile(np.arange(shape[1]), len(some))
            yield batch_of(schema, cell, ref, low[some].ravel(), high[some].ravel(), wide[cell], count[cell])

        schema = "cell long, ref long, low double, high double, wide double, n long"
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
        placed = own.mapInArrow(assign, f"{kinds}, cell long").checkpoint()
        sums = placed.select("x", "cell").mapInArrow(bounds, schema).groupBy("cell", "ref").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("wide").alias("wide"), F.sum("n").alias("n"))
        sizes, wide = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        low, high = np.zeros((len(pivots), min(REFERENCES, len(pivots)))), np.zeros((len(pivots), min(REFERENCES, len(pivots))))
        for r in sums.collect():  # pivots times references
            sizes[r.cell], wide[r.cell], low[r.cell, r.ref], high[r.cell, r.ref] = r.n, r.wide, r.low, r.high
        self.bounds = Bounds(pivots, sizes, wide, low, high)
        parts = [(c, -(-int(k) // block)) for c, k in enumerate(sizes) if k]
        deal = points.sparkSession.createDataFrame(parts, "cell long, parts long")
        self.blocks = deal.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("cell", (F.col("cell") * (1 << 32) + F.col("part")).alias("block"))
        self.rows = placed.join(F.broadcast(deal), "cell").withColumn("block", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
        self.count = sum(k for _, k in parts)

    def near(self, limit: float | DataFrame) -> DataFrame:
        """(block, cells array<boolean>): of each block the cells that may hold points as near as ``limit``, a number or (block, up)."""
        lower = self.blocks.sparkSession.sparkContext.broadcast(self.bounds.lower)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = columns(batch)
                    near = [lower.value[c] <= u for c, u in zip(rows["block"] >> 32, rows["up"])]
                    yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(near, pa.list_(pa.bool_()))], names=["block", "cells"])

        limits = self.blocks.select("block", F.lit(float(limit)).alias("up")) if isinstance(limit, (int, float)) else limit.select("block", "up")
        return limits.mapInArrow(run, "block long, cells array<boolean>")

    def pairs(self, limit: float | DataFrame) -> DataFrame:
        """(own, other): blocks that may hold points as near as ``limit``, a number or (block, up)."""
        lower = self.blocks.sparkSession.sparkContext.broadcast(self.bounds.lower)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = columns(batch)
                near = [np.flatnonzero(lower.value[c] <= u) for c, u in zip(rows["block"] >> 32, rows["up"])]
                yield batch_of("own long, cell long", np.repeat(rows["block"], [len(x) for x in near]), np.concatenate([np.zeros(0, np.int64), *near]))

        limits = self.blocks.select("block", F.lit(float(limit)).alias("up")) if isinstance(limit, (int, float)) else limit.select("block", "up")
        return limits.mapInArrow(run, "own long, cell long").join(self.blocks.withColumnRenamed("block", "other"), "cell").select("own", "other")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows that are sorted by block, a batch a block."""
    now, held = None, []
    for batch in batches:
        if batch.num_rows:
            block = batch.column("block").to_numpy()
            edges = (np.flatnonzero(np.diff(block)) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if block[a] != now and held:
                    yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                now = block[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _own(block: int, batch: pa.RecordBatch) -> Rows:
    rows = columns(batch)
    rows.pop("block", None)
    return {"own": np.full(batch.num_rows, block), **rows}


def visit(rows: DataFrame, near: DataFrame | None, fresh: Callable[[Rows], object], schema: str) -> DataFrame:
    """What ``fresh(own).done()`` gives for each block, a batch of ``schema``, after ``see(other)`` of all blocks that are ``near``
    (block, cells; see ``Placed.near``).

    A block is packed into one row, once, in the checkpoint folder; tasks read from there the blocks that they compare, so what is
    sent and stored does not grow with the pairs. A task keeps others of HELD bytes at hand and works on one block after another.
    Where all others are more, visitors of one block are joined by ``absorb``.
    """
    ship(rows.sparkSession)
    sorted_ = rows.drop("cell")
    if near is None:
        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, batch in _whole(batches):
                yield fresh(_own(block, batch)).done()

        return sorted_.repartition("block").sortWithinPartitions("block").mapInArrow(alone, schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _whole(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])

    tasks = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    packed = sorted_.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(pack, "block long, packed binary").checkpoint()
    size = packed.agg(F.sum(F.length("packed"))).first()[0] or 0
    turns = max(1, -(-size // HELD))
    others = packed.coalesce(turns).select(F.shiftright("block", 32).cast("int").alias("cell"), F.col("packed").alias("other"))
    met = packed.join(F.broadcast(near), "block").hint("shuffle_replicate_nl").join(others, F.col("cells")[F.col("cell")]).select("block", "packed", "other")

    def unpacked(value: pa.Scalar) -> pa.RecordBatch:
        return pa.ipc.open_stream(value.as_buffer()).read_next_batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, visitor = None, None
        for batch in batches:
            blocks, own, other = batch.column("block").to_pylist(), batch.column("packed"), batch.column("other")
            for i, block in enumerate(blocks):
                if block != now:
                    if visitor is not None:
                        yield given(now, visitor)
                    now, visitor = block, fresh(_own(block, unpacked(own[i])))
                visitor.see(columns(unpacked(other[i])))
        if visitor is not None:
            yield given(now, visitor)

    if turns == 1:
        given = lambda block, visitor: visitor.done()
        return met.mapInArrow(run, schema)

    def given(block: int, visitor: object) -> pa.RecordBatch:
        visitor.own = {c: v for c, v in visitor.own.items() if c != "x"}
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pickle.dumps(visitor)], pa.binary())], names=["block", "visitor"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole = None, None
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("visitor")):
                part = pickle.loads(part.as_buffer())
                if block == now:
                    whole.absorb(part)
                    continue
                if whole is not None:
                    yield whole.done()
                now, whole = block, part
        if whole is not None:
            yield whole.done()

    return met.mapInArrow(run, "block long, visitor binary").repartition("block").sortWithinPartitions("block").mapInArrow(join, schema)
