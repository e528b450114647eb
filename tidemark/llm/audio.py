"""Operator 7, media columns: texts as 8-bit audio, with log-mel tensors of a fixed shape and time spans.

The payload of a text is kept as unsigned 8-bit PCM in a WAV container. The stored bytes are read back, resampled by a
polyphase filter, cut into overlapped frames, mapped to log-mel energies and segmented by a hysteresis on frame energy.

Spark has no column type of a fixed shape, so a row's tensors are one binary value: an Arrow stream with a fixed-shape tensor
column and the start and end of each tensor, which ``read_tensors`` or any Arrow reader opens without a copy.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, blobs, pick, read, slices

UNIT = 192
RATE = 8000
#: 8000 Hz to 6000 Hz.
UP, DOWN, TAPS = 3, 4, 12
FRAME, HOP, MELS = 256, 128, 16
#: Frames in one tensor: its shape is (BLOCK, MELS).
BLOCK = 32
#: Frames that one step of the feature loop holds.
STEP = 1 << 14
#: A segment opens above the mean log energy plus HIGH deviations and closes below the mean plus LOW deviations.
HIGH, LOW = 0.5, -0.25

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, media binary, tensors binary, spans array<struct<start_ms:double,end_ms:double>>, "
    "segments array<struct<start_ms:double,end_ms:double>>"
)
#: What Spark's schema says of the tensors.
SHAPE = {"format": "arrow stream", "tensor": "float32", "shape": [BLOCK, MELS]}


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples; chunks other than fmt and data are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(None)
def _phases() -> list[tuple[int, np.ndarray]]:
    """For each of UP outputs: how far its first input lies from the start, and its taps in the order of the inputs."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(n + 2)[1:-1]
    h *= UP / h.sum()
    return [(DOWN * r // UP, h[(DOWN * r) % UP :: UP][::-1].astype(np.float32)) for r in range(UP)]


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: each output is a dot product of TAPS inputs with the taps of its phase."""
    groups = -(-len(x) // DOWN)
    padded = np.zeros(TAPS - 1 + groups * DOWN + DOWN, np.float32)
    padded[TAPS - 1 : TAPS - 1 + len(x)] = x
    out = np.empty((groups, UP), np.float32)
    step = padded.strides[0]
    for r, (start, taps) in enumerate(_phases()):
        out[:, r] = np.lib.stride_tricks.as_strided(padded[start:], (groups, TAPS), (DOWN * step, step)) @ taps
    return out.ravel()[: -(-len(x) * UP // DOWN)]


@lru_cache(None)
def _filters() -> tuple[np.ndarray, np.ndarray]:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS) log energies of overlapped frames; the last frame is filled up with zeros."""
    window, filters = _filters()
    frames = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(y)] = y[: len(padded)]
    out = np.empty((frames, MELS), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    for at in range(0, frames, STEP):
        spectrum = np.fft.rfft(view[at : at + STEP] * window, axis=1)
        out[at : at + STEP] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ filters + 1e-6)
    return out


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Runs of frames [start, end) that open above one threshold and stay open until energy falls below a lower one."""
    mean, dev = float(energy.mean()), float(energy.std())
    mark = np.where(energy > mean + high * dev, 1, np.where(energy < mean + low * dev, 0, -1))
    known = np.where(mark >= 0, np.arange(len(mark)), 0)
    state = np.maximum(mark[np.maximum.accumulate(known)], 0)
    edge = np.diff(np.concatenate([[0], state, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]], str]:
    """Tensors (blocks, BLOCK, MELS), their spans in ms, voiced segments in ms, and a digest of all."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    found = segments(mel.mean(axis=1))
    blocks = -(-len(mel) // BLOCK)
    tensor = np.zeros((blocks * BLOCK, MELS), np.float32)
    tensor[: len(mel)] = mel
    ms = 1000 * HOP * DOWN / (UP * RATE)
    spans = [(k * BLOCK * ms, min((k + 1) * BLOCK, len(mel)) * ms) for k in range(blocks)]
    voiced = [(a * ms, b * ms) for a, b in found]
    means = ",".join(f"{v:.2f}" for v in mel.mean(axis=0) + 0.0)
    digest = f"frames={len(mel)};segments={len(found)};voiced={sum(b - a for a, b in found)};mel={means}"
    return tensor.reshape(blocks, BLOCK, MELS), spans, voiced, digest


_STORED = pa.schema([("tensor", pa.fixed_shape_tensor(pa.float32(), [BLOCK, MELS])), ("start_ms", pa.float64()), ("end_ms", pa.float64())])


def store_tensors(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream of fixed-shape tensors with their time spans."""
    sink = pa.BufferOutputStream()
    starts, ends = (pa.array(x, pa.float64()) for x in zip(*spans))
    with pa.ipc.new_stream(sink, _STORED) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors)), starts, ends], schema=_STORED))
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """Columns tensor (fixed shape), start_ms and end_ms."""
    with pa.ipc.open_stream(stored) as f:
        return f.read_all()


def media_features(df: DataFrame) -> DataFrame:
    """One row for each row of ``df`` (doc_id, text): digests, the stored form, tensors, their spans, and voiced segments.

    Null text counts as empty, whose payload is one unit of spaces. Equal texts have equal values. Texts of any length are
    taken whole. Repeated rows and null ids stay; other columns are ignored; an empty frame gives an empty frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        spans = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), spans, spans]
        say = lambda xs: [{"start_ms": a, "end_ms": b} for a, b in xs]
        for part in slices(batches):
            rows = []
            for text in blobs(part.column("text")):
                media = to_wav(payload(text))
                back = from_wav(media)[1]
                tensor, where, voiced, digest = features(back)
                shas = hashlib.sha256(back).hexdigest(), hashlib.sha256(media).hexdigest()
                rows.append((len(text), len(back), shas[0], zlib.crc32(back[-16:]), len(media), shas[1], digest, media, store_tensors(tensor, where), say(where), say(voiced)))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=names)

    out = arrow_map(pick(df, "doc_id", "text"), run, SCHEMA)
    return out.withColumn("tensors", F.col("tensors").alias("tensors", metadata=SHAPE))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read(spark, sf_dir, "documents"))
