"""Operator 12, quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

A text is the set of its n-grams: single words and pairs of words (ASCII letters in lower case), and one to GRAMS symbols of
its outline. The outline has one symbol for each run of bytes of one kind (small letters, capitals, digits; every other byte
is a kind of its own), and REPEAT in the place of a word that equals the word before. An indicator's weight is the logarithm
of how much more often the n-gram's bucket is in texts of label 1 than in those of label 0; vectors have unit length. The
hinge loss is minimised by dual coordinate descent over a bounded sample of labelled rows. Margins become scores by a logistic
curve that is fitted to margins of rows left out of the fit, each label weighing as much as it does among all labelled rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WHITE, arrow_map, blobs, labelled, pick, read, slices
from ._nets import sigmoid
from .neardup import mix, word_places

#: Labelled rows of each label that training reads at most, and the length of the longest of them.
SAMPLE, MOST_CHARS = 1500, 20_000
#: Buckets of n-grams, and symbols of the longest outline n-gram.
BUCKETS, GRAMS = 1 << 17, 5
#: Texts of label 1 are kept from this score on.
LEAST = 0.7
COST, EPOCHS, FOLDS = 1.0, 30, 3
STEP_BYTES = 2 << 20
REPEAT = 1

_SOLID = np.ones(256, bool)
_SOLID[[*WHITE, 0]] = False
_KIND = np.arange(256, dtype=np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = ord("a")
_KIND[128:] = ord("a")
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = ord("A")
_KIND[list(b"0123456789")] = ord("0")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _bucket(keys: np.ndarray, salt: int) -> np.ndarray:
    return (mix(keys * _PRIME + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int32)


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct buckets of each text's n-grams, ascending."""
    raw = np.frombuffer(b"\0".join([t.replace(b"\0", b" ") for t in texts]) + b"\0", np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    starts, sizes, words = word_places(np.frombuffer(raw.tobytes().lower(), np.uint8), _SOLID)
    of_word = owner[starts]
    paired = of_word[1:] == of_word[:-1]
    streams = [(of_word, _bucket(words, 1)), (of_word[1:][paired], _bucket(words[1:][paired] * _PRIME + words[:-1][paired], 2))]
    kinds = _KIND[raw]
    again = np.flatnonzero(paired & (words[1:] == words[:-1])) + 1
    ends = np.cumsum(sizes[again])
    kinds[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[again] - (ends - sizes[again]), sizes[again])] = REPEAT
    keep = np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (owner[1:] != owner[:-1])])
    outline, of_symbol = kinds[keep].astype(np.uint64), owner[keep]
    key = np.zeros(len(outline), np.uint64)
    for n in range(1, GRAMS + 1):
        if len(outline) < n:
            break
        key = (key[: len(outline) - n + 1] << np.uint64(8)) | outline[n - 1 :]
        whole = (of_symbol[: len(key)] == of_symbol[n - 1 :]) & (outline[n - 1 :] > 0)
        streams.append((of_symbol[: len(key)][whole], _bucket(key[whole], 2 + n)))
    cuts = [(np.searchsorted(of, np.arange(len(texts) + 1)).tolist(), buckets) for of, buckets in streams]
    seen = np.zeros(BUCKETS, bool)
    for i in range(len(texts)):
        for at, buckets in cuts:
            seen[buckets[at[i] : at[i + 1]]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


class Model:
    """A margin is the mean of ``weights`` over a text's n-grams in the scaled, normalised space, and ``bias``; a score its logistic."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.scaled, self.squares = (ratios * weights).astype(np.float64), (ratios * ratios).astype(np.float64)
        self.bias, self.slope, self.shift = bias, slope, shift

    def margin(self, found: np.ndarray) -> float:
        return float(self.scaled[found].sum() / np.sqrt(self.squares[found].sum() + 1e-12) + self.bias)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        margins = np.array([self.margin(f) for f in features(texts)]) if texts else np.zeros(0)
        return sigmoid(self.slope * margins + self.shift)


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each bucket, the logarithm of its smoothed share among the indicators of label 1 over that among those of label 0."""
    shares = []
    for value in (1, 0):
        some = [r for r, y in zip(rows, labels) if y == value]
        count = 1.0 + np.bincount(np.concatenate([np.zeros(0, np.int64), *some]).astype(np.int64), minlength=BUCKETS)
        shares.append(count / count.sum())
    return np.log(shares[0] / shares[1])


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the least hinge loss by dual coordinate descent; each label's costs add up to the same."""
    rng = np.random.default_rng(seed)
    n = len(rows)
    values = [ratios[r] / np.sqrt((ratios[r] ** 2).sum() + 1e-12) for r in rows]
    signs = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2)
    cost = COST * n / 2 / share[labels]
    norms = np.array([float(v @ v) + 1.0 for v in values])  # the bias is a feature that is always 1
    alpha, weights, bias = np.zeros(n), np.zeros(BUCKETS), 0.0
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(n).tolist():
            slope = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                most = max(most, abs(step))
            alpha[i] = new
        if most < 1e-3:
            break
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and shift of the logistic curve of least loss; a label weighs as its share says."""
    x = np.stack([margins, np.ones(len(margins))], 1)
    weight = share[labels] / np.bincount(labels, minlength=2)[labels]
    # Targets a little inside of 0 and 1, so the curve of labels that margins part stays finite.
    target = np.where(labels == 1, 1 - 1 / (len(labels) + 2), 1 / (len(labels) + 2))
    at = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ at)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (target - p)) - 1e-6 * at)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def train(texts: list[bytes], labels: np.ndarray, share: tuple[float, float] | None = None) -> Model:
    """From texts with labels 0 or 1, which have the given shares among all. With one label only, all scores lie on its side."""
    labels = np.asarray(labels, np.int64)
    count = np.bincount(labels, minlength=2)
    if not count.all():
        side = -30.0 if count[0] and not count[1] else 30.0
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), side)
    rows = [f.astype(np.int32) for at in range(0, len(texts), 100) for f in features(texts[at : at + 100])]
    fold = np.zeros(len(rows), np.int64)
    for value in (0, 1):
        fold[labels == value] = np.arange(count[value]) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        kept = np.flatnonzero(fold != k)
        if not np.bincount(labels[kept], minlength=2).all():
            kept = np.arange(len(rows))
        some = [rows[i] for i in kept]
        ratios = log_ratios(some, labels[kept])
        model = Model(ratios, *descend(some, labels[kept], ratios))
        for i in np.flatnonzero(fold == k):
            margins[i] = model.margin(rows[i])
    ratios = log_ratios(rows, labels)
    weights, bias = descend(rows, labels, ratios)
    return Model(ratios, weights, bias, *calibrate(margins, labels, np.array(share if share else count / count.sum())))


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """On at most ``sample`` labelled rows of each label, none of them held out."""
    rows = labelled(docs, labels, "quality", lambda: fold() != 2, sample, MOST_CHARS)
    counted = pick(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").filter(fold() != 2).groupBy("quality").count().collect()
    total = {r["quality"]: r["count"] for r in counted}
    n = max(1, sum(total.values()))
    return train([t.encode() for t, _ in rows], np.array([y for _, y in rows], np.int64), (total.get(0, 0) / n, total.get(1, 0) / n))


def score(df: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of ``df`` (doc_id, text).

    Null and empty texts have no n-grams and get the score of the bias. Texts of any length are read whole; equal texts score
    alike; repeated rows and null ids stay; an empty frame gives an empty frame; other columns are ignored. The model has a
    number for each bucket and is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=STEP_BYTES):
            found = shared.value.scores(blobs(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return arrow_map(pick(df, "doc_id", "text"), run, "doc_id long, score double")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
