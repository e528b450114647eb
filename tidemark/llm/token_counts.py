"""Operator 8, token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates vocabulary matches; dynamic programming carries the best score and its piece count for
every end position, and no segmentation is built. The vocabulary and scores come from a SentencePiece model file, read as a
unigram model with byte fallback: scores add up exactly in doubles, a later candidate replaces an earlier one only by a
strictly higher score (starts ascending), an unknown character scores the lowest vocabulary score less 10, and unknown
characters count as their UTF-8 bytes (byte fallback). Spaces become U+2581, and one stands before the text.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import arrow_map, blobs, pick, read, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of words that a worker remembers, with what an entry costs besides; beyond them it forgets all.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 160

SCHEMA = "doc_id long, n_tokens long, n_chars long"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocab(path: str) -> list[tuple[str, float]]:
    """Pieces that texts can match, with their scores: control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


class _Known(dict):
    """Counts of words by what ``make`` says; all are forgotten when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, word: str) -> int:
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        self.held += ENTRY_BYTES + 4 * len(word)
        n = self[word] = self.make(word)
        return n


class Counter:
    """Counts of texts under one unigram vocabulary."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        pieces = [p for p, _ in vocab]
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        # Cuts before a run of marks and around line ends are exact only if no piece reaches over them.
        self.splits = MARK in pieces and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.after_mark = _Known(lambda w: self.viterbi(MARK + w))
        self.other = _Known(self.viterbi)

    def viterbi(self, text: str) -> int:
        """Pieces of the best segmentation; work grows with the number of vocabulary matches."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, pieces, single = None, 0, False
            for size, score in sorted(ends[end - 1], reverse=True):  # longest first, so starts ascend
                single |= size == 1
                s = best[end - size] + score
                if top is None or s > top:
                    top, pieces = s, count[end - size] + 1
            if not single:
                s = best[end - 1] + self.unknown
                if top is None or s > top:
                    top, pieces = s, count[end - 1] + len(text[end - 1].encode())
            best[end], count[end] = top, pieces
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a text; empty texts have none."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.splits:
            return self.viterbi(marked)
        total = marked.count("\n")
        for line in marked.split("\n"):
            first, *rest = line.split(MARK)
            if "" in rest:
                total += sum(map(self.other.__getitem__, re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line)))
            else:
                total += sum(map(self.after_mark.__getitem__, rest)) + (self.other[first] if first else 0)
        return total


#: One counter a worker, by a digest of its vocabulary.
_counters: dict[str, Counter] = {}


def token_counts(df: DataFrame, vocab: list[tuple[str, float]] | None = None) -> DataFrame:
    """Tokens of each row of ``df`` (doc_id, text) under ``vocab`` (pieces with scores; by default the public model's).

    Null and empty texts count 0. Repeated rows and null ids stay; other columns are ignored. Texts of any length are counted
    whole, an empty frame gives an empty frame. The vocabulary has a fixed size and is broadcast.
    """
    vocab = vocab or load_vocab(default_model())
    key = hashlib.md5(repr(vocab).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        counter = _counters[key]
        for part in slices(batches):
            texts = [t.decode("utf-8", "replace") for t in blobs(part.column("text"))]
            cols = [part.column("doc_id"), pa.array([counter.count(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_chars"])

    return arrow_map(pick(df, "doc_id", "text"), run, SCHEMA)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
