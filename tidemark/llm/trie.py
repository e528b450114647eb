"""Operator 11, conversation prefix trie: a Cartesian tree over the LCP array of sorted conversations.

1. A turn is a 128-bit digest of role and text; a conversation is one binary key, the digests of its turns in order. Sorted by
   key and id, each conversation has the number of first turns that it shares with the one before: the LCP array.
2. Blocks are the partitions of the sorted table. The nearest smaller value on either side of an LCP value bounds the interval
   of conversations that share so many turns. Equal values with equal bounds are one node of the tree; a node stands for all
   depths above its parent's; what is deeper than both neighbours belongs to one conversation.
3. An interval that reaches over a block's end is continued in others. Its name is (block where it begins, depth), which
   every block finds by the nearest smaller of the blocks' minima: a number a block is all that is broadcast.
4. Counts, smallest ids and sums over subtrees are sums over intervals (``Block.rows``), so portions of one node add up.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import arrow_map, cut, pick, read

#: Bytes of a turn in a key.
TURN = 16
#: A conversation takes its first turns from the first of FAMILY ids; how many, from its own id, is below HEADS.
FAMILY, HEADS = 5, 9
NOTHING = hashlib.sha256().hexdigest()

_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, shared long, before long, ends string, home long, parent_home long, block long"
_EDGES = "block long, n long, low long, first binary, last binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def turns(df: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as structs of a digest (hex) and the text's UTF-8 bytes.

    Turns are ordered by turn, nulls first, then by role and by the digest of role and text; repeated rows all stay. Null role
    or text counts as empty. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = pick(df, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = rows.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), F.struct("turn", role.alias("role"), mark.alias("mark"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    # A family lies in one partition, so neither this grouping nor the window in ``rebuilt`` shuffles again.
    return rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")).select("base", "conv_id", F.transform("own", lambda t: F.struct(t["mark"].alias("mark"), t["size"].alias("size"))).alias("own"))


def rebuilt(df: DataFrame) -> DataFrame:
    """conv_id, key and sizes of each conversation after its head was exchanged for that of its family's first."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    heads = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEADS - 1))).over(Window.partitionBy("base"))
    all_ = turns(df).withColumn("head", heads).withColumn("h", h.cast("int"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    tail = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    said = all_.select("conv_id", F.concat(head, tail).alias("said"))
    return said.select("conv_id", F.unhex(F.array_join(F.transform("said", lambda t: t["mark"]), "")).alias("key"), F.transform("said", lambda t: t["size"]).alias("sizes"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n = min(len(a), len(b)) // TURN
    if a[: n * TURN] == b[: n * TURN]:
        return n
    differ = np.frombuffer(a, np.uint64, 2 * n) != np.frombuffer(b, np.uint64, 2 * n)
    return int(differ.argmax()) // 2


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value to the left of each; -1 where there is none."""
    out, stack, held = np.full(len(values), -1), [], values.tolist()
    for i, v in enumerate(held):
        while stack and held[stack[-1]] >= v:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def homes(lows: list[int], block: int, top: int) -> np.ndarray:
    """For each depth up to ``top``, the nearest block before ``block`` whose minimum is smaller: there a node that is open to the left begins."""
    out, at, depth = np.zeros(top + 1, np.int64), block, top
    while depth >= 0:
        at -= 1
        if lows[at] < depth:
            out[lows[at] + 1 : depth + 1] = at
            depth = lows[at]
    return out


class Block:
    """Sorted conversations of one partition. ``lcp[i]`` is shared with the one before, ``lcp[n]`` by the last and the next block's first."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, lcp: np.ndarray):
        self.ids, self.lengths, self.lcp = ids, lengths, lcp
        self.total = np.concatenate([[0], np.cumsum(sizes)])  # bytes of all turns before each turn of the block
        self.first = np.cumsum(lengths) - lengths

    def bytes_before(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bytes of the first n turns of conversations."""
        return self.total[self.first[at] + n] - self.total[self.first[at]]

    def rows(self, name: int, lows: list[int]) -> pa.RecordBatch:
        """All nodes with members here; those that other blocks may hold as well have a home."""
        n, lcp, lengths = len(self.ids), self.lcp, self.lengths
        left = nearest_smaller(lcp)
        right = n - nearest_smaller(lcp[::-1])[::-1]  # n + 1 where there is none
        # Equal values with the same left bound are one node.
        keys = np.stack([left, lcp], 1)
        _, some, node = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        node = node.ravel()
        low, high, top = left[some], right[some], lcp[some]
        wide = np.concatenate([[-1], lcp, [-1]])  # bounds out of the block hold no depth back
        floor = np.maximum(wide[low + 1], wide[high + 1])
        above = np.where(wide[low + 1] >= wide[high + 1], low, high)
        # What one conversation has alone.
        one = np.arange(n)
        floor_one = np.maximum(lcp[:-1], lcp[1:])
        above_one = np.where(lcp[:-1] >= lcp[1:], one, one + 1)
        inner = len(some)
        low, high = np.concatenate([low, one]), np.concatenate([high, one + 1])
        top, floor, above = np.concatenate([top, lengths]), np.concatenate([floor, floor_one]), np.concatenate([above, above_one])
        open_left, open_right = low < 0, high > n
        low, high = np.maximum(low, 0), np.minimum(high, n)

        leaf = np.concatenate([[0], np.cumsum((lcp[1:] < lengths) | (lcp[1:] < 0))])
        met = np.concatenate([[0], np.cumsum(self.bytes_before(one, np.maximum(lcp[:-1], 0)))])
        least = np.minimum.reduceat(np.append(self.ids, np.iinfo(np.int64).max), np.stack([low, high], 1).ravel())[::2]
        begins = np.zeros(len(low), np.int64)  # children that begin after the node's own beginning
        begins[:inner] = np.bincount(node[:n], weights=lengths > lcp[:-1], minlength=inner)
        own = ~open_left & (lengths[low] > top)  # the child that begins where the node does

        end = np.where(lcp[1:] == lengths, node[1:], np.where(lcp[:-1] == lengths, node[:-1], inner + one))
        said: dict[int, list[str]] = {}
        for unit, conv in zip(end.tolist(), self.ids.tolist()):
            said.setdefault(unit, []).append(str(conv))

        # One row for each depth.
        depths = np.maximum(top - floor, 0)
        unit = np.repeat(np.arange(len(low)), depths)
        start = np.cumsum(depths) - depths
        within = np.arange(len(unit)) - start[unit]
        depth = floor[unit] + 1 + within
        deepest = depth == top[unit]
        upper = np.where(above < 0, 0, np.minimum(above, n))
        parent = np.where(within > 0, np.arange(len(unit)) - 1, (start + depths - 1)[node[upper[unit]]])
        opened = (open_left | open_right)[unit]
        reach = open_left[unit]
        home = np.full(len(unit), name)
        home[reach] = homes(lows, name, int(depth[reach].max(initial=-1)))[depth[reach]]
        rooted = depth > 0
        parent_open = rooted & opened[parent]
        ends = []
        for u, last, is_open in zip(unit.tolist(), deepest.tolist(), opened.tolist()):
            ids = said.get(u) if last else None
            ends.append((",".join(ids) if ids else None) if is_open else hashlib.sha256(",".join(ids).encode()).hexdigest() if ids else NOTHING)
        at = low[unit]
        cols = [
            pa.array(least[unit]),
            pa.array(depth),
            pa.array(least[unit][parent], mask=~(rooted & ~parent_open)),
            pa.array((high - low)[unit]),
            pa.array(np.where(deepest, (begins + own)[unit], ~open_left[unit])),
            pa.array((leaf[high] - leaf[low])[unit]),
            pa.array((met[high] - met[np.where(open_left, 0, low + 1)])[unit]),
            pa.array(self.bytes_before(at, np.maximum(depth - 1, 0))),
            pa.array(ends, pa.string()),
            pa.array(home, mask=~opened),
            pa.array(home[parent], mask=~parent_open),
            pa.array(np.full(len(unit), name)),
        ]
        return pa.RecordBatch.from_arrays([c.cast(pa.int64()) if not pa.types.is_string(c.type) else c for c in cols], names=_names(_NODES))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What other blocks must know of a block: its ends, and the smallest LCP value within."""
    n, low, first, last = 0, 2**62, None, None
    for batch in batches:
        for key in batch.column("key").to_pylist():
            if n:
                low = min(low, common(last, key))
            else:
                first = key
            n, last = n + 1, key
    if n:
        row = (TaskContext.get().partitionId(), n, low, first, last)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(),) * 3 + (pa.binary(),) * 2)], names=_names(_EDGES))


def nodes(ordered: DataFrame) -> DataFrame:
    """Nodes of each block of ``ordered`` (conv_id, key, sizes), a checkpointed table sorted by key and conv_id."""
    held = sorted(arrow_map(ordered.select("key"), _edges, _EDGES).collect(), key=lambda r: r["block"])  # a row a partition
    shared = [-1, *(common(a["last"], b["first"]) for a, b in zip(held, held[1:])), -1]
    lows = [min(r["low"], s) for r, s in zip(held, shared)]
    place = {r["block"]: i for i, r in enumerate(held)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, sizes, lcp, last = [], [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("sizes")
            ids.append(batch.column("conv_id").to_numpy())
            lengths.append(np.diff(found.offsets.to_numpy()))
            sizes.append(found.flatten().to_numpy())
            for key in batch.column("key").to_pylist():
                lcp.append(0 if last is None else common(last, key))
                last = key
        if not ids:
            return
        at = place[TaskContext.get().partitionId()]
        lcp[0] = shared[at]
        block = Block(*(np.concatenate(x).astype(np.int64) for x in (ids, lengths, sizes)), np.array([*lcp, shared[at + 1]], np.int64))
        yield block.rows(at, lows)

    return arrow_map(ordered, run, _NODES)


def _digests(chunks: DataFrame) -> DataFrame:
    """Digests of the ends of nodes in several blocks: ids stream by, block after block, in order."""
    schema = "home long, depth long, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], names=_names(schema))

        for batch in batches:
            for home, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("home", "depth", "ends"))):
                if (home, depth) != now:
                    if now:
                        yield row()
                    now, digest = (home, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
        if now:
            yield row()

    return arrow_map(chunks.repartition("home", "depth").sortWithinPartitions("home", "depth", "block"), run, schema)


def prefix_trie(df: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``df`` (conv_id, turn, role, text), one row for each node.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. A null role or text is empty, null turns come first, equal turns are ordered by role and digest, repeated rows
    all stay; rows without a conv_id belong to no conversation. A conversation is one row of 16 bytes a turn from the first
    step on, so texts of any length cost no more. An empty table has no conversation and no node; other columns are ignored.
    """
    ordered = cut(cut(rebuilt(df)).orderBy("key", "conv_id"))
    parts = cut(nodes(ordered))
    whole, open_ = parts.filter("home is null"), parts.filter("home is not null")
    sums = [f(c).alias(c) for f, c in ((F.min, "conv_id"), *((F.sum, c) for c in ("n_convs", "n_children", "n_leaves", "shared")), *((F.max, c) for c in ("before", "parent_home")))]
    spans = cut(open_.groupBy("home", "depth").agg(*sums))
    digests = _digests(open_.filter("ends is not null").select("home", "depth", "block", "ends"))
    named = spans.select(F.col("home").alias("parent_home"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up"))
    spans = spans.join(digests, ["home", "depth"], "left").join(named, ["parent_home", "depth"], "left")
    spans = spans.withColumn("parent_conv_id", F.col("up")).withColumn("ends", F.coalesce("ends_sha256", F.lit(NOTHING)))
    # A node within a block whose parent isn't: the parent's id comes by block, so the root's many children don't meet in one place.
    here = open_.select("block", F.col("home").alias("parent_home"), (F.col("depth") + 1).alias("depth")).join(named, ["parent_home", "depth"])
    under = whole.filter("parent_home is not null").join(here, ["block", "parent_home", "depth"]).withColumn("parent_conv_id", F.col("up"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("shared") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    return whole.filter("parent_home is null").select(*cols).unionByName(under.select(*cols)).unionByName(spans.select(*cols))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))
