"""Operator 10, near-duplicates: fast similarity sketches, banding and exact verification.

1. A document's set holds 64-bit hashes of its distinct five-word shingles. Documents with equal sets are one class, so
   copies cost one row each from here on.
2. Sketch: every element goes to a bin chosen by hash, round after round, until each of T bins holds a value; from round T on
   an element goes to one bin a round, so every coordinate is filled after 2T rounds at most. Lower rounds win, then lower
   values. Bands of ROWS coordinates are the bucket keys.
3. Links: in each bucket all classes are compared with its smallest (a star, not all pairs). Afterwards only buckets that
   still hold several components matter: members outside the largest component are compared with the others, in blocks of a
   fixed size within Python tasks, which return links alone. Every pair that shares a bucket is so compared, or already
   connected; every link is confirmed on full sets.
4. Components by contraction of links over checkpointed tables.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import components as contracted
from ._common import WHITE, arrow_map, blobs, checkpoint_dir, cut, pick, read, slices

SHINGLE = 5
#: Linked are pairs with 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
BANDS, ROWS = 30, 5
#: Members of a bucket in one block of the exhaustive comparison, and probes in one.
BLOCK, PROBES = 2048, 512
#: Members that are compared with one copy of their bucket's smallest.
RUN = 1024

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: near numbers go far apart."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SOLID = np.ones(256, bool)
_SOLID[list(WHITE)] = False


def word_places(raw: np.ndarray, solid_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and 64-bit hashes of runs of the given bytes: a polynomial of the bytes, mixed with the size."""
    solid = solid_bytes[raw]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    sizes = ends - starts
    begun = np.zeros(len(raw), np.int64)
    begun[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(begun)  # from the word's start
    place[~solid] = 0
    value = (raw + np.uint64(1)) * _powers(int(sizes.max()))[place]
    value[~solid] = 0
    return starts, sizes, mix(np.add.reduceat(value, starts) ^ (sizes.astype(np.uint64) << np.uint64(48)))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, ASCII letters in lower case."""
    return word_places(np.frombuffer(text.lower(), np.uint8), _SOLID)[2]


@lru_cache(8)
def _powers_up_to(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return _powers_up_to(1 << max(6, (n - 1).bit_length()))


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of shingles; of the whole sequence where words are fewer; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    width = min(size, len(words))
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(h)


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch: coordinate b is (round, value) of the first round, then lowest value, that reached bin b.

    In the first ``bins`` rounds each element draws a bin; round bins + b puts all elements into bin b, so every coordinate
    fills. Rounds are taken several at a time while the elements are few.
    """
    empty = ~np.uint64(0)
    out = np.full(bins, empty, np.uint64)
    once = max(1, min(2 * bins, -(-10 * bins // len(elements))))
    for low in range(0, 2 * bins, once):
        rounds = np.arange(low, min(low + once, 2 * bins), dtype=np.uint64)
        h = mix(elements ^ mix((rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))[:, None])
        at = (h >> np.uint64(40)) % np.uint64(bins)
        late = rounds >= bins
        at[late] = (rounds[late] - np.uint64(bins))[:, None]
        key = (rounds[:, None] << np.uint64(48)) | (mix(h) >> np.uint64(16))  # the round first, then the value
        np.minimum.at(out, at.ravel().astype(np.int64), key.ravel())
        if not (out == empty).any():
            break
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + coordinates.reshape(bands, rows)[:, k])
    return keys.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < threshold * large:
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= threshold * (len(a) + len(b) - same)


_SKETCHED = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"


def sketches(df: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """Size, 128-bit digest and bucket keys of each row's set; keys are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, a, b, keys = [], [], [], []
            for text in blobs(part.column("text")):
                s = shingle_set(text, size)
                n.append(len(s))
                a.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mix(s * _M2 + np.uint64(7)).sum(dtype=np.uint64).view(np.int64)))
                keys.append(band_keys(sketch(s, bands * rows), bands, rows).tolist() if len(s) else None)
            cols = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, a, b)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SKETCHED.split(", ")])

    return arrow_map(df, run, _SKETCHED)


def components(nodes: DataFrame, links: DataFrame, node: str = "id") -> DataFrame:
    """(id, root): the smallest id that each node of ``nodes`` reaches over ``links`` (a, b).

    Links are contracted round after round until few enough are left for one task; each round is a checkpointed table.
    """
    checkpoint_dir(nodes.sparkSession)
    found = contracted(links.select("a", "b"))
    return nodes.select(F.col(node).alias("id")).join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


class Index:
    """Sets by their elements: the sizes of a set's intersections with all of them in one pass."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.roots = np.array([r[1] for r in rows], np.int64)
        self.sizes = np.array([len(r[2]) for r in rows], np.int64)
        flat = np.concatenate([r[2] for r in rows])
        order = np.argsort(flat, kind="stable")
        self.elements = flat[order]
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)[order]

    def links(self, own: np.ndarray, root: int, threshold: int) -> list[int]:
        """Those of another root with 100 * intersection >= threshold * union."""
        lo, hi = np.searchsorted(self.elements, own, "left"), np.searchsorted(self.elements, own, "right")
        n = hi - lo
        ends = np.cumsum(n)
        where = np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)
        same = np.bincount(self.owner[where], minlength=len(self.ids))
        hit = (self.roots != root) & (100 * same >= threshold * (len(own) + self.sizes - same))
        return self.ids[hit].tolist()


def _verify_stars(pairs: DataFrame, texts: DataFrame, threshold: int, size: int) -> DataFrame:
    """Links among ``pairs`` (pivot, id): a pivot's set stands first among its rows and is made once."""
    # A pivot with many members is dealt to runs of about RUN of them, each with the pivot's text in front.
    runs = cut(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs")))
    dealt = cut(pairs.join(runs, "pivot").select("pivot", "id", F.pmod(F.xxhash64("id"), F.col("runs")).alias("run")))
    heads = dealt.select("pivot", "run").distinct().join(texts.withColumnRenamed("id", "pivot"), "pivot")
    members = dealt.join(texts, "id").select("pivot", "run", "id", "text", F.lit(1).alias("member"))
    rows = members.unionByName(heads.select("pivot", "run", F.col("pivot").alias("id"), "text", F.lit(0).alias("member")))
    rows = rows.repartition("pivot", "run").sortWithinPartitions("pivot", "run", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, []
        for batch in slices(batches):
            a, b = [], []
            for pivot, r, doc, member, text in zip(*(batch.column(c).to_pylist() for c in ("pivot", "run", "id", "member")), blobs(batch.column("text"))):
                own_set = shingle_set(text, size)
                if (pivot, r) != now:
                    now, heads = (pivot, r), []
                if not member:
                    heads.append(own_set)  # more than one only where a doc_id repeats with other texts
                elif any(linked(head, own_set, threshold) for head in heads):
                    a.append(pivot)
                    b.append(doc)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return arrow_map(rows, run, "a long, b long")


def _verify_rest(buckets: DataFrame, texts: DataFrame, threshold: int, size: int) -> DataFrame:
    """Links between members of one bucket that are in different components, confirmed on full sets.

    ``buckets`` has key, id, root, and only keys with several roots. Probes are the members outside the bucket's largest
    component; each block of probes meets each block of members in a group of bounded size.
    """
    by_root = buckets.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = by_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("members"), F.max("n").alias("top"))
    # Both sides come from tables, so the join of a hot key's rows can be split; a sum on the key right below would forbid it.
    rows = buckets.join(cut(main), "key")
    probe_blocks = F.ceil((F.col("members") - F.col("top")) / PROBES).cast("int")
    member_blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.select("key", "id", "root", (F.col("root") != F.col("main")).alias("probe"), probe_blocks.alias("pb"), member_blocks.alias("mb"))
    h = F.xxhash64("id", "key")
    members = rows.select("key", F.pmod(h, F.col("mb")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("p"), "id", "root", F.lit(1).alias("kind"))
    probes = rows.filter("probe").select("key", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod(h, F.col("pb")).cast("int").alias("p"), "id", "root", F.lit(0).alias("kind"))
    met = members.unionByName(probes)
    # Only classes that buckets still hold in several components need their texts.
    grouped = met.join(texts, "id").repartition("key", "m", "p").sortWithinPartitions("key", "m", "p", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, probes, index = None, [], None
        for batch in slices(batches):
            a, b = [], []
            for key, m, p, doc, root, kind, text in zip(*(batch.column(c).to_pylist() for c in ("key", "m", "p", "id", "root", "kind")), blobs(batch.column("text"))):
                if (key, m, p) != now:
                    now, probes, index = (key, m, p), [], None
                own = shingle_set(text, size)
                if not kind:
                    probes.append((doc, root, own))
                    continue
                if not probes:  # the hash dealt none to this block
                    continue
                index = index or Index(probes)
                for other in index.links(own, root, threshold):
                    a.append(min(doc, other))
                    b.append(max(doc, other))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return arrow_map(grouped, run, "a long, b long").distinct()


#: What tells a class of equal sets: two sums of hashes and the size.
_SET = ["set_a", "set_b", "n_shingles"]
#: Classes with more than one row in HOT of all are hot: there are fewer than HOT of them, whatever the input.
HOT = 1000


def _by_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the columns of their class, of which ``n`` counts its rows.

    The rows of hot classes stay where they are and meet a broadcast table of fewer than HOT rows; the others are shuffled, and
    no class among them has more than one row in HOT.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(classes.filter(F.col("n") * HOT > total))
    rest = rows.join(hot.select(*_SET), _SET, "left_anti").join(classes.filter(F.col("n") * HOT <= total), _SET)
    return rows.join(hot, _SET).unionByName(rest)


def near_duplicates(df: DataFrame, threshold: int = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``df`` (doc_id, text).

    Null texts and texts without words have empty sets: they are linked with nothing and stay. component_id is the smallest
    doc_id reachable over links; kept is whether it is the row's own. Rows that repeat a doc_id are one document, linked
    as any of its texts is; rows with a null doc_id are compared with nothing, have a null component_id and are kept. Texts of any
    length are taken whole; extra columns are ignored; an empty frame gives an empty frame. A pair at the threshold shares no band with probability under 3e-8.
    Shingles are compared by 64-bit hashes and classes of equal sets by two 64-bit sums of these, not by their words again.
    """
    docs = pick(df, "doc_id", "text")
    known = cut(sketches(docs, bands, rows, size))
    full = known.filter("n_shingles > 0 and doc_id is not null")
    # Classes of equal sets; a class is called by its smallest document.
    named = full.groupBy(*_SET).agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.count("*").alias("n"))
    classes = cut(named.select(*_SET, "id", "n"))
    entries = named.select("id", F.explode("keys").alias("key")).distinct()
    entries = cut(entries)
    pivots = entries.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("key", "pivot")
    shared = cut(entries.join(pivots, "key"))
    members = shared.select("id").distinct()
    texts = docs.withColumnRenamed("doc_id", "id").join(members, "id", "left_semi")
    pairs = cut(shared.filter("id <> pivot").select("pivot", "id").distinct())
    stars = cut(_verify_stars(pairs, texts, threshold, size))
    with_root = cut(shared.select("key", "id").join(components(members, stars), "id"))
    several = with_root.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    # With two members the star has compared them.
    unsettled = with_root.join(cut(several.filter("lo <> hi and n > 2").select("key")), "key")
    rest = cut(_verify_rest(cut(unsettled), texts, threshold, size))
    links = stars.unionByName(rest)
    # A document of several rows hangs on all of their classes.
    ends = full.groupBy("doc_id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in _SET for f in (F.min, F.max)))
    twice = cut(ends.filter(" or ".join(f"min_{c} <> max_{c}" for c in _SET)).select("doc_id"))
    if not twice.isEmpty():
        of_several = _by_class(full.select("doc_id", *_SET).join(twice, "doc_id", "left_semi"), classes)
        links = links.unionByName(of_several.filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")))
    rooted = cut(classes.join(components(classes.select("id").distinct(), links).distinct(), "id").select(*_SET, "n", F.col("root").alias("component_id")))
    found = _by_class(full.select("doc_id", *_SET), rooted).select("doc_id", "n_shingles", "component_id")
    empty = known.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; all documents without words stay.

    Rows without a doc_id are compared with nothing and stay; rows that repeat a doc_id are one document and stay or go
    together. Texts of any length are taken whole; an empty frame gives an empty frame.
    """
    found = near_duplicates(docs, threshold=80, bands=36, rows=4).filter("kept").select("doc_id").filter("doc_id is not null").distinct()
    rows = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    return rows.join(found, "doc_id", "left_semi").unionByName(rows.filter("doc_id is null")).select("doc_id", "text", "lang", "source", "n_chars")
