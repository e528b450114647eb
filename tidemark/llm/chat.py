"""Operator 5, chat formatting: conversations assembled column by column into one byte buffer.

Segment lengths, their running offsets and scatter indices are computed in numpy for a whole batch of turns; headers and
contents are then copied into one preallocated buffer, which becomes an Arrow column.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, blobs, pick, read

OPEN, TEXT, CLOSE = b"<|turn|>", b"<|text|>", b"<|end|>\n"
#: Strings that no formatted text may hold but where the template puts them.
CONTROLS = (b"<|turn|>", b"<|text|>", b"<|end|>", b"<|im_start|>", b"<|im_end|>", b"<|endoftext|>", b"</s>", b"<s>", b"[/INST]", b"[INST]", b"<</SYS>>", b"<<SYS>>")
_ESCAPE = re.compile(b"|".join([re.escape(b"\\"), *map(re.escape, CONTROLS)]))
_BACK = re.compile(rb"\\(\\?)")
_TURN = re.compile(re.escape(OPEN) + rb"(.*?)" + re.escape(TEXT) + rb"(.*?)" + re.escape(CLOSE), re.DOTALL)
#: The role whose texts are under the loss mask.
LEARNT = b"assistant"

PARTS = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def escape(text: bytes) -> bytes:
    """A backslash is doubled; one more splits every control string after its first byte. ``unescape`` undoes it."""
    return _ESCAPE.sub(lambda m: b"\\\\" if m[0] == b"\\" else m[0][:1] + b"\\" + m[0][1:], text)


def unescape(text: bytes) -> bytes:
    return _BACK.sub(rb"\1", text)


def _escaped(column: pa.Array) -> pa.Array:
    """Only values that hold a control string or a backslash are touched."""
    data = column.cast(pa.binary())
    data = pa.compute.fill_null(data, b"")
    hit = pa.compute.match_substring_regex(data, r"[\\<\[]").to_numpy(zero_copy_only=False)
    if not hit.any():
        return data
    values = data.to_pylist()
    for i in np.flatnonzero(hit):
        values[i] = escape(values[i])
    return pa.array(values, pa.binary())


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary array."""
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def _copy(out: np.ndarray, starts: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
    """Scatter: value i of (raw, offsets) goes to out[starts[i]:]."""
    out[np.repeat(starts - offsets[:-1], np.diff(offsets)) + np.arange(len(raw))] = raw


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: bytes, offsets of the turns, and (start, end) of each turn's content."""
    role_raw, role_at = _flat(_escaped(roles))
    text_raw, text_at = _flat(_escaped(texts))
    sizes = np.stack([np.full(len(roles), len(OPEN)), np.diff(role_at), np.full(len(roles), len(TEXT)), np.diff(text_at), np.full(len(roles), len(CLOSE))], 1)
    starts = np.concatenate([[0], np.cumsum(sizes.ravel())])
    places = starts[:-1].reshape(-1, 5)
    out = np.empty(starts[-1], np.uint8)
    for k, mark in ((0, OPEN), (2, TEXT), (4, CLOSE)):
        out[places[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _copy(out, places[:, 1], role_raw, role_at)
    _copy(out, places[:, 3], text_raw, text_at)
    return out, starts[::5], np.stack([places[:, 3], places[:, 4]], 1)


def format_chats(df: DataFrame) -> DataFrame:
    """Parts of formatted conversations, ordered by (conv_id, part) within each partition.

    ``df`` has conv_id, turn, role, text. A conversation is the rows of one conv_id (null is one of its own) by turn, role
    and text, nulls first; repeated rows and equal turns all stay. Null role or text counts as empty. A conversation comes
    in one part, or in more where it spans Arrow batches, so memory stays bounded however long it is; the parts in order
    are the whole. ``loss`` holds byte spans of assistant contents within the part. An empty frame gives an empty frame.
    """
    rows = pick(df, "conv_id", "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        part = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            out, turns, content = assemble(batch.column("role"), batch.column("text"))
            ids = batch.column("conv_id").to_pylist()
            first = [i for i in range(n) if i == 0 or ids[i] != ids[i - 1]]
            ends = [*first[1:], n]
            learnt = [r == LEARNT for r in blobs(batch.column("role"))]
            numbers, loss = [], []
            for a, b in zip(first, ends):
                part = part + 1 if last == (ids[a],) else 0
                last = (ids[a],)
                numbers.append(part)
                loss.append([{"start": int(content[i, 0] - turns[a]), "end": int(content[i, 1] - turns[a])} for i in range(a, b) if learnt[i]])
            cuts = turns[[*first, n]]
            text = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[a] for a in first], pa.int64()),
                    pa.array(numbers, pa.int64()),
                    pa.array([b - a for a, b in zip(first, ends)], pa.int64()),
                    text.cast(pa.binary()).cast(pa.string()),
                    pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["conv_id", "part", "n_turns", "formatted", "loss"],
            )

    return arrow_map(rows, run, PARTS)


def _points(text: bytes) -> int:
    return len(text.translate(None, bytes(range(0x80, 0xC0))))


def digest(parts: DataFrame) -> DataFrame:
    """Read the output of ``format_chats`` back: one row for each conversation, parts streamed in order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []

        def flush(rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            done = []
            for conv, part, text, loss in zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), blobs(batch.column("formatted")), batch.column("loss").to_pylist()):
                if part == 0:
                    if now:
                        done.append([now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]])
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in _TURN.findall(text):
                    now[1] += 1
                    now[2].update(unescape(role) + b"\n" + unescape(said) + b"\n")
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    now[3] += _points(said)
                    now[4].update(said)
                now[5] += _points(text)
            if done:
                yield flush(done)
        if now:
            yield flush([[now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]]])

    return arrow_map(parts, run, schema)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = pick(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return digest(format_chats(rows.unionByName(own)))
