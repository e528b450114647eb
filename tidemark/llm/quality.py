"""Operator 9, quality rules: line-first cleaning.

Every line is judged on its own by punctuation, navigation and boilerplate rules; failing lines go, and a document that
loses too much of its text goes as a whole. Base counts of the whole text are returned beside the verdict.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import WHITE, arrow_map, blobs, pick, read, slices

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Marks that end a sentence, also when quotes or brackets follow.
TERMINAL = (".", "!", "?", "…", ":", ";", "。", "！", "？")
_CLOSERS = "\"'”’»)]} \t\r\x0b\x0c"
#: Short lines with one of these are page furniture, not prose.
BOILERPLATE = re.compile(
    r"all rights reserved|copyright|©|\(c\) \d{4}|licen[sc]ed? under|licen[sc]e agreement|cookie|privacy policy"
    r"|terms of (?:use|service)|javascript|subscribe|sign up|log ?in|click here|read more|lorem ipsum|spdx",
    re.IGNORECASE,
)
#: A line of fewer words needs a terminal mark.
SHORT_LINE = 3
BOILERPLATE_WORDS = 40
#: A document that loses a larger part of its non-space bytes is rejected.
MOST_LOST = 0.5

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, lines_punctuation long, lines_navigation long, lines_boilerplate long, lost double, clean_text string"
)


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more; windows are compared exactly."""
    n = len(words)
    if n <= size:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    key, base = ids[: n - size + 1], len(known)
    span = base
    for k in range(1, size):
        if span * base >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
            span = len(key)
        key = key * base + ids[k : n - size + 1 + k]
        span *= base
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[back] >= 2
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[: n - size + 1] += twice
    edge[size:] -= twice[: n - size + 1]
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    solid = text.translate(None, WHITE)
    chars = len(solid.translate(None, _CONTINUATION))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def line_fault(line: bytes) -> str:
    """'' for a line that stays, else the rule that it breaks."""
    words = len(line.split())
    if not words:
        return ""
    bars = line.count(b"|") + line.count("›".encode()) + line.count("»".encode()) + line.count("•".encode())
    if bars >= 2 and 4 * bars >= words:
        return "navigation"
    solid = len(line) - line.count(b" ")
    marks = len(line) - len(line.translate(None, SYMBOLS))
    shouts = line.count(b"!!") + line.count(b"??")
    if 10 * marks >= solid or (shouts >= 2 and 2 * shouts >= words):
        return "punctuation"
    text = line.decode("utf-8", "replace")
    if words <= BOILERPLATE_WORDS and BOILERPLATE.search(text):
        return "boilerplate"
    if words < SHORT_LINE and not text.rstrip(_CLOSERS).endswith(TERMINAL):
        return "punctuation"
    return ""


def judge(text: bytes, most_lost: float = MOST_LOST) -> tuple:
    """All columns of SCHEMA but doc_id."""
    counts = base_counts(text)
    base_failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
    faults = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    stay, lost, total = [], 0, 0
    for line in text.split(b"\n"):
        fault = line_fault(line)
        solid = len(line) - line.count(b" ")
        total += solid
        if fault:
            faults[fault] += 1
            lost += solid
        else:
            stay.append(line)
    share = lost / total if total else 0.0
    kept = not base_failed and share <= most_lost
    return (*counts, base_failed, kept, *faults.values(), share, b"\n".join(stay).decode("utf-8", "replace"))


def clean(df: DataFrame, most_lost: float = MOST_LOST, with_text: bool = True) -> DataFrame:
    """One row for each row of ``df`` (doc_id, text).

    Null text counts as empty; empty texts have no words, so ``base_failed`` is true. A null doc_id stays null, repeated
    rows are judged one by one, other columns are ignored. Texts of any length are taken whole, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.float64()]
        for part in slices(batches):
            rows = [judge(t, most_lost) for t in blobs(part.column("text"))]
            cols = list(zip(*rows))
            out = [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            out.append(pa.array(cols[11] if with_text else [None] * len(rows), pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return arrow_map(pick(df, "doc_id", "text"), run, SCHEMA)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(read(spark, sf_dir, "documents"), with_text=False).drop("clean_text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents with their failing lines removed, in the columns of ``documents``.

    Null and empty texts have no words and go. Repeated rows are judged alike and stay rows of their own, as do rows without an
    id; texts of any length are judged whole; an empty frame gives an empty frame.
    """
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [judge(t) for t in blobs(part.column("text"))]
            mask = pa.array([r[6] for r in rows], pa.bool_())
            text = pa.array([r[11] for r in rows], pa.string())
            whole = pa.RecordBatch.from_arrays(
                [part.column("doc_id"), text, part.column("lang"), part.column("source"), pa.compute.utf8_length(text).cast(pa.int64())],
                names=["doc_id", "text", "lang", "source", "n_chars"],
            )
            yield whole.filter(mask)

    return arrow_map(pick(docs, "doc_id", "text", "lang", "source"), run, schema)
