"""Operator 2, byte-level BPE encoding and decoding by one global shuffle of distinct words.

1. Blocks: a run of documents is split into pre-tokens, once. A block keeps where each pre-token stands (as numbers of the
   block's distinct words) and explodes its distinct words, dealt into parts by a hash of the word. Both are checkpointed, and
   all that follows is read from there, so the input is never split again, however it is ordered when read again.
2. Words: one part of all blocks meets in one place; each distinct word is encoded once and its ids go back to every block
   that asked for it.
3. Documents: a block joins its words' ids to its positions, which gives each document's ids in order. Decoding joins ids to
   the table of token bytes (50,256 rows, a fixed size, hence broadcast).

What is shuffled is the block's positions once and its distinct words there and back, compressed, not a row a pre-token.
Blocks are named by their content, words included: blocks of one name are alike.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import arrow_map, blobs, cut, pick, read, slices

#: Characters of text in a block: the more, the fewer words are sent twice.
BLOCK_CHARS = 32 << 20
#: Least number of parts that a block's words are dealt into; each part of all blocks is met in one task, so there are as many
#: as the session has shuffle partitions, which a cluster sets by its input.
PARTS = 64

#: Of compression: a few seconds more a GB save a tenth of what is written.
LEVEL = 6

_ROWS = "block string, part long, sub long, data binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class _Numbers(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        return n


_WIDE = re.compile(r"\s\s")


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed value; ``unpack`` reads them."""
    raws = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    body = np.array([len(raws), *map(len, raws)], np.int64).tobytes() + b"".join(raws)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(body, asbytes=True)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    body = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    sizes = np.frombuffer(body, np.int64, n, 8)
    ends = 8 + 8 * n + np.cumsum(sizes)
    return [np.frombuffer(body[e - s : e], k) for s, e, k in zip(sizes, ends, kinds)]


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 with their bytes apart, which compresses better."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def by_high(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers below 2**32 as their upper bytes, and their lowest bytes in the order of the upper ones, where alike ones meet."""
    n = numbers.astype("<u4")
    high = n >> 8
    return planes(high), n.astype(np.uint8)[np.argsort(high, kind="stable")].tobytes()


def from_high(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    top = from_planes(high)
    out = np.empty(len(top), np.int64)
    order = np.argsort(top, kind="stable")
    out[order] = low
    return out + (top.astype(np.int64) << 8)


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] for all i, end to end."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)]


class Block:
    """Documents split into pre-tokens."""

    def __init__(self, pattern):
        self.find = pattern.findall
        self.first, self.spaced, self.whole = _Numbers(), _Numbers(), _Numbers()
        self.ids: list[int | None] = []
        self.runs: list[tuple[int, np.ndarray]] = []  # 0: pieces after a space but the first; 2: pre-tokens as they are
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        self.ids.append(doc_id)
        self.size += len(text)
        if _WIDE.search(text):
            words = self.find(text)
            self.runs.append((2, np.fromiter(map(self.whole.__getitem__, words), np.uint32, len(words))))
            return
        # Between single spaces that no white space adjoins, pre-tokens are found piece by piece.
        parts = text.split(" ")
        row = np.empty(len(parts), np.uint32)
        row[0] = self.first[parts[0]]
        row[1:] = np.fromiter(map(self.spaced.__getitem__, parts[1:]), np.uint32, len(parts) - 1)
        self.runs.append((0, row))

    def seal(self, parts: int) -> tuple[str, list[tuple[int, list[bytes]]], bytes]:
        """Its name, its distinct words by part, and its positions."""
        kinds = (self.first, ""), (self.spaced, " "), (self.whole, "")
        shift = np.cumsum([0, *(len(keys) for keys, _ in kinds)])
        rows = []
        for kind, row in self.runs:
            row = row.astype(np.int64)
            if kind == 2:
                row += shift[2]
            else:
                row[1:] += shift[1]
            rows.append(row)
        seq = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        # Frequent pieces get low numbers, which take less room.
        order = np.argsort(-np.bincount(seq, minlength=shift[3]), kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        pieces = [lead + k for keys, lead in kinds for k in keys]
        words, sizes, flat = _Numbers(), np.ones(len(order), np.uint32), array("I")
        for at, k in enumerate(order.tolist()):
            if k < shift[2]:
                found = self.find(pieces[k])
                sizes[at] = len(found)
                flat.extend(map(words.__getitem__, found))
            else:
                flat.append(words[pieces[k]])
        flat = np.array(flat, np.uint32)
        raw = [w.encode() for w in words]
        part = np.array([zlib.crc32(w) % parts for w in raw], np.uint16)
        dealt: dict[int, list[bytes]] = {}
        for k, w in zip(part.tolist(), raw):
            dealt.setdefault(k, []).append(w)
        nulls = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        # Words are numbered as they come up: 0 stands for the next new one.
        new = np.ones(len(flat), bool)
        new[1:] = np.maximum.accumulate(flat)[:-1] < flat[1:]
        data = pack(nulls, ids, np.array([len(r) for r in rows], np.int64), *by_high(number[seq]), planes(sizes), *by_high(np.where(new, 0, flat + 1)), planes(part))
        name = hashlib.sha1(data)
        name.update(np.array([len(w) for w in raw], np.uint32).tobytes() + b"".join(raw))
        return name.hexdigest() + f"-{len(self.ids)}", sorted(dealt.items()), data


def open_block(data: bytes, ids: dict[int, list[np.ndarray]]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a block. ids: the block's words by part, in their order, each as (sizes, flat ids)."""
    nulls, docs, counts, high, low, sizes, word_high, word_low, part = unpack(data, np.uint8, np.int64, np.int64, *[np.uint8] * 6)
    seq, sizes, part = from_high(high, low), from_planes(sizes).astype(np.int64), from_planes(part).astype(np.int64)
    code = from_high(word_high, word_low)
    words = np.where(code == 0, np.cumsum(code == 0), code) - 1
    # Answers stand by part; a word's place there is its part's begin and how many of its part came before it.
    rank = np.empty(len(part), np.int64)
    rank[np.argsort(part, kind="stable")] = np.arange(len(part))
    words = rank[words]
    known = [ids[k] for k in sorted(ids)]
    per_word = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in known)]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *(x[1] for x in known)]).astype("<u4")
    if len(per_word) != len(part):
        raise ValueError("a block's words did not all come back")
    starts = np.cumsum(per_word) - per_word
    # Ids of each distinct piece, then of each document.
    piece_words = np.cumsum(sizes) - sizes
    tokens_at = np.concatenate([[0], np.cumsum(per_word[words])])
    piece_ids = spread(flat, starts[words], per_word[words])
    piece_start = tokens_at[piece_words]
    piece_size = tokens_at[piece_words + sizes] - piece_start
    at = 0
    for null, doc, n in zip(nulls, docs, counts):
        row = seq[at : at + n]
        at += n
        yield None if null else int(doc), spread(piece_ids, piece_start[row], piece_size[row])


def _blocks(df: DataFrame, pattern: str, parts: int) -> DataFrame:
    """A row for each block's positions (part -1) and for its words of each part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)

        def seal(block: Block) -> pa.RecordBatch:
            name, dealt, data = block.seal(parts)
            rows = [(name, -1, len(dealt), data)]
            rows += [(name, p, 0, pack(planes(np.array([len(w) for w in ws])), b"".join(ws))) for p, ws in dealt]
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["block", "part", "sub", "data"])

        block = Block(split)
        for part in slices(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), blobs(part.column("text"))):
                block.add(doc, text.decode("utf-8", "replace"))
                if block.size >= BLOCK_CHARS:
                    yield seal(block)
                    block = Block(split)
        if block.ids:
            yield seal(block)

    return arrow_map(df, run, _ROWS)


def encode(df: DataFrame, ranks: dict[bytes, int] | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """Token ids of each row of ``df`` (doc_id, text): doc_id, ids array<long>; or, with ``digests``, the digest columns.

    Null and empty texts have no ids. Repeated rows stay rows of their own and null ids stay null; other columns are
    ignored. Texts may be of any length; a text longer than a block is a block alone. An empty frame gives an empty frame.
    """
    sc = df.sparkSession.sparkContext
    ranks = default_ranks() if ranks is None else ranks
    pattern = pattern or default_pattern()
    table = sc.broadcast(ranks)
    docs = pick(df, "doc_id", "text")
    parts = max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=table.value, special_tokens={})
        single = table.value
        known: dict[bytes, bytes] = {}
        now = None
        for batch in batches:
            out = []
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                if part != now:
                    known, now = {}, part  # a part's rows stand together, and no other part has its words
                sizes, raw = unpack(data, np.uint8, np.uint8)
                raw, at, found = raw.tobytes(), 0, []
                for n in from_planes(sizes).tolist():
                    word = raw[at : at + n]
                    at += n
                    ids = known.get(word)
                    if ids is None:
                        one = single.get(word)
                        ids = known[word] = np.array([one] if one is not None else own.encode_ordinary(word.decode()), "<u4").tobytes()
                    found.append(ids)
                out.append(pack(planes(np.array([len(x) // 4 for x in found])), *by_high(np.frombuffer(b"".join(found), "<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), batch.column("sub"), pa.array(out, pa.binary())], names=["block", "part", "sub", "data"])

    blocks = cut(_blocks(docs, pattern, parts))
    words = blocks.filter("part >= 0").repartition("part").sortWithinPartitions("part", "block")
    answers = arrow_map(words, lookup, _ROWS)
    met = blocks.filter("part < 0").unionByName(answers).repartition("block").sortWithinPartitions("block", "part")

    if digests:
        schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        schema = "doc_id long, ids array<long>"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(table.value) if digests else None

        def close(bodies: list[bytes], answers: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if answers and not bodies:
                raise ValueError("ids came back for a block that is not there")
            for body in bodies:  # alike blocks of repeated rows share a name
                rows = []
                for doc, ids in open_block(body, answers):
                    if digests:
                        rows.append((doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoder.bytes_of(ids)).hexdigest()))
                    else:
                        rows.append((doc, ids.astype(np.int64)))
                cols = list(zip(*rows))
                if digests:
                    arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                else:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in cols[1]])]).astype(np.int32)
                    arrays = [pa.array(cols[0], pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(cols[1]))]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

        now, bodies, answers = None, [], {}
        for batch in batches:
            for name, part, data in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("data").to_pylist()):
                if name != now:
                    yield from close(bodies, answers)
                    now, bodies, answers = name, [], {}
                if part < 0:
                    bodies.append(data)
                elif part not in answers:
                    sizes, high, low = unpack(data, np.uint8, np.uint8, np.uint8)
                    answers[part] = [from_planes(sizes), from_high(high, low)]
        yield from close(bodies, answers)

    return arrow_map(met, join, schema)


class Decoder:
    """The token-byte table, joined to ids by position."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for raw, i in ranks.items():
            table[i] = raw
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(table), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        return spread(self.raw, self.starts[ids], self.sizes[ids]).tobytes()


def decode(df: DataFrame, ranks: dict[bytes, int] | None = None) -> DataFrame:
    """Texts of rows (doc_id, ids): doc_id, text binary. Null ids count as none; an unknown id is an error."""
    table = df.sparkSession.sparkContext.broadcast(default_ranks() if ranks is None else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(table.value)
        for batch in batches:
            texts = [decoder.bytes_of(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return arrow_map(pick(df, "doc_id", "ids"), run, "doc_id long, text binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), digests=True)
