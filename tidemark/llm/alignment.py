"""Operator 13, cross-tokenizer alignment: where the tokens of two tokenizers lie over the same bytes.

Tokenizer A reads a space and the text, tokenizer B the text, before which it puts a space of its own. Every byte has an owner
in A and one in B: ``np.repeat`` of token numbers by token sizes. Wherever the pair of owners changes a new overlap (a link)
begins, wherever both change at once both tokenizers have a cut, which ends a group.

Neither tokenizer has a token that reaches from a character that is no white space over a following space or line end, so texts
are parted there into chunks, and each distinct chunk of a block of documents is encoded and aligned once. A block also counts
its pairs of linked ids. Counts of the corpus are sums over blocks; they meet the blocks again by pair, never the documents.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, blobs, cut, pick, read, slices

MARK = "▁"
#: Bytes of text that make a block; a longer text is a block with what came before it. And chunks encoded at once.
BLOCK_BYTES, BATCH = 10 << 20, 20_000
#: A chunk begins with a space or line end that follows no white space, or at the text's start.
_CHUNK = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_BLOCKS = "block long, pairs array<long>, n array<long>, docs binary, words binary"


def default_tokenizers() -> tuple[str, bytes]:
    """The JSON of A and the model file of B."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def _packed(**columns: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of the given sizes, some of which may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Chunks:
    """Distinct chunks, aligned: counts and group strings of each, and its links as pairs of ids."""

    def __init__(self, n: int):
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.good = np.zeros(n, bool)
        self.groups: list[str] = [""] * n
        self.pairs = np.zeros(0, np.int64)


class Aligner:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a: str, b: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        # The alphabet of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [i for i in range(256) if i not in shown]
        byte_of = {chr(i): i for i in shown} | {chr(256 + k): i for k, i in enumerate(rest)}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if set(token) <= byte_of.keys() else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.mark = self.b.piece_to_id(MARK)
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        #: Chunks are exact only if no piece reaches over their ends.
        self.splits = MARK in plain and not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)

    def chunks(self, text: str) -> list[str]:
        """Parts of a space and the text, which both tokenizers encode apart."""
        return _CHUNK.findall(f" {text}") if self.splits else [f" {text}"]

    def _a_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A, chunk after chunk, and how many each has. All but those that end in white space are encoded as one text."""
        ragged = [i for i, c in enumerate(chunks) if c[-1].isspace()]
        if ragged:
            parts = [self._a_ids([c for c in chunks if not c[-1].isspace()])]
            apart = [e.ids for e in self.a.encode_batch([chunks[i] for i in ragged], add_special_tokens=False)]
            odd = np.zeros(len(chunks), bool)
            odd[ragged] = True
            sizes = np.zeros(len(chunks), np.int64)
            sizes[~odd], sizes[odd] = parts[0][1], [len(x) for x in apart]
            ids, of_odd = np.zeros(sizes.sum(), np.int64), np.repeat(odd, sizes)
            ids[~of_odd], ids[of_odd] = parts[0][0], [t for x in apart for t in x]
            return ids, sizes
        ids = np.array(self.a.encode("".join(chunks), add_special_tokens=False).ids, np.int64) if chunks else np.zeros(0, np.int64)
        ends = np.cumsum([len(c.encode()) for c in chunks])
        at = np.searchsorted(np.cumsum(self.a_sizes[ids]), ends) + 1
        return ids, np.diff(at, prepend=0)

    def _b_ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of B, whose own space stands for a chunk's first one, and goes where a line end comes first."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [(ids or [self.mark]) if c[0] == " " else ids[1:] for c, ids in zip(chunks, found)]

    def align(self, chunks: list[str]) -> Chunks:
        out = Chunks(len(chunks))
        pairs = [self._align(out, chunks[at : at + BATCH], at) for at in range(0, len(chunks), BATCH)]
        out.pairs = np.concatenate(pairs) if pairs else out.pairs
        return out

    def _align(self, out: Chunks, chunks: list[str], first: int) -> np.ndarray:
        """Fill ``out`` from place ``first`` on; the links of all chunks in order, A's id in the high half."""
        a, n_a = self._a_ids(chunks)
        b_ids = self._b_ids(chunks)
        n_b = np.array([len(x) for x in b_ids])
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, n_b.sum())
        size = np.array([len(c.encode()) for c in chunks])
        good = (_sums(self.a_sizes[a], n_a) == size) & (_sums(self.b_sizes[b], n_b) == size)
        raw = "".join(chunks).encode()
        if not good.all() or any(b"".join(map(table.__getitem__, ids.tolist())) != raw for table, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            a_list, ends = a.tolist(), np.cumsum(n_a).tolist()
            for i, (c, end, n, y) in enumerate(zip(chunks, ends, n_a.tolist(), b_ids)):
                good[i] = b"".join(map(self.a_bytes.__getitem__, a_list[end - n : end])) == c.encode() == b"".join(map(self.b_bytes.__getitem__, y))
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a[good], n_b[good]
        if not len(a):
            return np.zeros(0, np.int64)
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.a_sizes[a]), np.repeat(np.arange(len(b)), self.b_sizes[b])
        new_a, new_b = (np.concatenate([[True], owner[1:] != owner[:-1]]) for owner in (owner_a, owner_b))
        begins = new_a | new_b
        link_a, link_b = owner_a[begins], owner_b[begins]
        cuts = new_a & new_b
        chunk_of = np.repeat(np.arange(len(n_a)), n_a)  # of each token of A
        n_groups = np.bincount(chunk_of[owner_a[cuts]], minlength=len(n_a))
        at = first + np.flatnonzero(good)
        out.good[at], out.n_a[at], out.n_b[at], out.n_groups[at] = True, n_a, n_b, n_groups
        out.n_links[at] = np.bincount(chunk_of[link_a], minlength=len(n_a))
        said = _said(a, b, np.append(owner_a[cuts], len(a)), np.append(owner_b[cuts], len(b)))
        done = 0
        for i, n in zip(at.tolist(), n_groups.tolist()):
            out.groups[i] = ";".join(said[done : done + n])
            done += n
        return a[link_a] << 32 | b[link_b]


def _said(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
    """What each group of tokens is called; those of one token on either side, which are nearly all, share their strings."""
    single = (np.diff(cut_a) == 1) & (np.diff(cut_b) == 1)
    pairs, which = np.unique(a[cut_a[:-1][single]] << 32 | b[cut_b[:-1][single]], return_inverse=True)
    said = np.empty(len(single), object)
    said[single] = np.array([f"{p >> 32}|{p & 0xFFFFFFFF}" for p in pairs.tolist()], object)[which]
    said_a, said_b = a.tolist(), b.tolist()
    for g in np.flatnonzero(~single).tolist():
        said[g] = f"{','.join(map(str, said_a[cut_a[g] : cut_a[g + 1]]))}|{','.join(map(str, said_b[cut_b[g] : cut_b[g + 1]]))}"
    return said.tolist()


class _Numbers(dict):
    """Distinct keys in order of arrival."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Block:
    """Documents as runs of numbered chunks."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.numbers = aligner, _Numbers()
        self.ids: list[int | None] = []
        self.rows: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, raw: bytes) -> None:
        chunks = self.aligner.chunks(raw.decode("utf-8", "replace")) if raw else []
        self.ids.append(doc)
        self.rows.append(np.array([*map(self.numbers.__getitem__, chunks)], np.int32))
        self.size += len(raw)

    def seal(self, name: int) -> pa.RecordBatch:
        """The block's pairs with their counts, its documents (complete but for these counts) and the links of its chunks."""
        table = self.aligner.align(list(self.numbers))
        # One chunk whose bytes differ leaves a document without tokens.
        rows = [r if table.good[r].all() else r[:0] for r in self.rows]
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows)
        digests = [hashlib.sha256(";".join([table.groups[c] for c in r.tolist()]).encode()).hexdigest() if len(r) else "" for r in rows]
        times = np.bincount(flat, minlength=len(table.good))
        pairs, which = np.unique(table.pairs, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, which, np.repeat(times, table.n_links))
        sums = {k: pa.array(_sums(getattr(table, k)[flat], sizes)) for k in ("n_a", "n_b", "n_groups", "n_links")}
        docs = _packed(doc_id=pa.array(self.ids, pa.int64()), **sums, groups_sha256=pa.array(digests), chunks=_lists(flat, sizes))
        words = _packed(links=_lists(which, table.n_links))
        cols = [pa.array([name], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in (pairs, counts)), pa.array([docs], pa.binary()), pa.array([words], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _BLOCKS.split(", ")])


def _opened(docs: bytes, words: bytes, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The block's documents with what the corpus's counts say of their links."""
    table, links = _unpacked(docs), _unpacked(words).column("links")
    pair, per_chunk = links.flatten().to_numpy(), np.diff(links.offsets.to_numpy())
    chunks = table.column("chunks")
    flat, sizes = chunks.flatten().to_numpy(), np.diff(chunks.offsets.to_numpy())
    n_best, count_sum = (pa.array(_sums(_sums(x[pair], per_chunk)[flat], sizes), pa.int64()) for x in (best, counts))
    cols = [*(table.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), n_best, count_sum, table.column("groups_sha256")]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])


def blocks_of(df: DataFrame, a: str, b: bytes, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block of documents, in the shared checkpoint folder."""
    shared = df.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        name = TaskContext.get().partitionId() << 32
        block = Block(aligner)
        for part in slices(batches):
            for doc, raw in zip(part.column("doc_id").to_pylist(), blobs(part.column("text"))):
                block.add(doc, raw)
                if block.size >= block_bytes:
                    yield block.seal(name)
                    name, block = name + 1, Block(aligner)
        if block.ids:
            yield block.seal(name)

    return cut(arrow_map(df, run, _BLOCKS))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count, best: how many links of the corpus hold a pair of ids, and whether no other A id has more with its B id."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.n").alias("n"))
    counts = cut(each.filter("n > 0").groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(df: DataFrame, a: str | None = None, b: bytes | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, counts of tokens, groups and links, what the corpus's counts say of the links, and the digest of the groups.

    ``df`` has doc_id and text; ``a`` is a tokenizer's JSON, ``b`` a model file's bytes. Null and empty texts, and texts that
    one of the tokenizers does not give back byte for byte, have no tokens: zeros and an empty digest column, and they add
    nothing to the counts. Repeated rows and null ids stay, each counted; ids tie for the highest count together. A very long
    text is a block alone or with the shorter ones before it; an empty frame gives an empty frame; other columns are ignored.
    """
    if a is None or b is None:
        own_a, own_b = default_tokenizers()
        a, b = own_a if a is None else a, own_b if b is None else b
    blocks = blocks_of(pick(df, "doc_id", "text"), a, b, block_bytes)
    each = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    known = each.join(pair_counts(blocks), "pair").select("block", "at", "count", "best", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("words"))
    # A block's own row comes after the counts of its pairs and says how many of these it has.
    own = blocks.select("block", F.lit(2**31 - 1).alias("at"), F.size("pairs").cast("long").alias("count"), F.lit(False).alias("best"), "docs", "words")
    met = known.unionByName(own).repartition("block").sortWithinPartitions("block", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            at, count, best = batch.column("at").to_numpy(), batch.column("count").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False)
            start = 0
            for i in np.flatnonzero(at == 2**31 - 1).tolist():
                held.append((at[start:i], count[start:i], best[start:i]))
                places, found, top = (np.concatenate(x) for x in zip(*held))
                counts, tops = np.zeros(count[i], np.int64), np.zeros(count[i], np.int64)
                counts[places], tops[places] = found, top
                yield _opened(batch.column("docs")[i].as_py(), batch.column("words")[i].as_py(), counts, tops)
                start, held = i + 1, []
            held.append((at[start:], count[start:], best[start:]))

    return arrow_map(met, run, SCHEMA)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"))
