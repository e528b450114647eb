"""Operator 1, toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding (words of the training sample; others share one) beside the mean embedding of its
character trigrams. Windows of WINDOW words overlap by half; all are scored, and a text's score is its highest window's.
Labels hold for whole texts, so training picks the windows of toxic texts that speak most for it, first by word odds, then by
the network itself. Training takes a bounded sample of labelled rows (SAMPLE of each label, of MOST_CHARS characters at most).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, blobs, labelled, pick, read, slices
from ._nets import Adam, gru, gru_back, init, scatter_rows, sigmoid
from .neardup import mix, word_places

#: Labelled rows of each label that training reads at most, and the length of the longest of them.
SAMPLE, MOST_CHARS = 1500, 6000
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 12, 8
TRIGRAMS = 4096
#: Documents of the sample that a word must be in to have an embedding of its own.
LEAST_DOCS = 3
ROUNDS, EPOCHS, BATCH = 2, 6, 256
#: Windows scored at once, and bytes of text.
SCORED, STEP_BYTES = 2048, 1 << 20

_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[128:] = True


class Tokens:
    """Words of some texts: distinct ones with their trigrams, and the windows over each text."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\0".join(texts).lower() + b"\0", np.uint8)
        starts, sizes, hashes = word_places(raw, _WORD)
        self.hashes, first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self._trigrams(raw, starts[first], sizes[first])
        ends = np.cumsum([len(t) + 1 for t in texts])
        word_at = np.searchsorted(starts, np.concatenate([[0], ends]))
        self.low, self.high = word_at[:-1], word_at[1:]
        n = self.high - self.low
        self.per_text = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(texts)), self.per_text)
        place = np.arange(len(text)) - np.repeat(np.cumsum(self.per_text) - self.per_text, self.per_text)
        self.text, self.begin = text, self.low[text] + place * STRIDE

    def _trigrams(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """One for each byte of a word: with the byte before and the byte after, 1 and 2 at the ends."""
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
        mid = raw[at].astype(np.uint64)
        before, after = np.concatenate([[0], mid[:-1]]).astype(np.uint64), np.concatenate([mid[1:], [0]]).astype(np.uint64)
        if total:
            before[ends - sizes], after[ends - 1] = 1, 2
        self.grams = (mix(before | mid << np.uint64(8) | after << np.uint64(16)) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.gram_at, self.gram_n = ends - sizes, sizes

    def windows(self, pick: np.ndarray) -> np.ndarray:
        """(WINDOW, picked) numbers of distinct words; past a text's end, the number of distinct words."""
        at = self.begin[pick] + np.arange(WINDOW)[:, None]
        inside = at < self.high[self.text[pick]]
        if not len(self.which):
            return np.zeros_like(at)
        return np.where(inside, self.which[np.minimum(at, len(self.which) - 1)], len(self.hashes))


class Model:
    def __init__(self, params: dict[str, np.ndarray], vocab: np.ndarray, shift: float = 0.0):
        self.p, self.vocab, self.shift = params, vocab, shift

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the word table; 0 for words that it lacks."""
        if not len(self.vocab):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, 0)

    def inputs(self, tokens: Tokens, ids: np.ndarray) -> np.ndarray:
        """Embeddings of the distinct words."""
        if not len(ids):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(self.p["chars"][tokens.grams], tokens.gram_at) / tokens.gram_n[:, None].astype(np.float32)
        return np.concatenate([self.p["words"][ids], chars], 1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs of both directions; the last row, for places past the end, keeps the state as it is."""
        rows = x @ self.p["in"] + self.p["in_bias"]
        rest = np.zeros((1, 6 * HIDDEN), np.float32)
        rest[0, :HIDDEN] = rest[0, 3 * HIDDEN : 4 * HIDDEN] = 30
        return np.concatenate([rows, rest])

    def forward(self, table: np.ndarray, windows: np.ndarray, keep: bool = False):
        x = table[windows]
        ahead, tape_a = gru(np.ascontiguousarray(x[:, :, : 3 * HIDDEN]), self.p["ahead"], keep)
        back, tape_b = gru(np.ascontiguousarray(x[::-1, :, 3 * HIDDEN :]), self.p["back"], keep)
        h = np.concatenate([ahead, back[::-1]], 2)
        a = np.tanh(h @ self.p["attend"])
        score = a @ self.p["score"] + np.where(windows == len(table) - 1, np.float32(-50), np.float32(0))
        w = np.exp(score - score.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * h).sum(0)
        return pooled @ self.p["out"] + self.p["out_bias"][0], (h, a, w, pooled, tape_a, tape_b)

    def gradients(self, windows: np.ndarray, labels: np.ndarray, tokens: Tokens, ids: np.ndarray) -> tuple[dict, float]:
        used, inverse = np.unique(windows, return_inverse=True)
        inverse = inverse.reshape(windows.shape)
        real = used[used < len(tokens.hashes)]
        if len(real) == len(used):
            local = inverse
        else:
            local = np.where(inverse == len(used) - 1, len(real), inverse)
        sub = _Sub(tokens, real)
        x = self.inputs(sub, ids[real])
        table = self.project(x)
        logit, (h, a, w, pooled, tape_a, tape_b) = self.forward(table, local, True)
        prob = sigmoid(logit)
        loss = float(-np.mean(np.where(labels == 1, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))))
        g = ((prob - labels) / len(labels)).astype(np.float32)
        grads = {"out": pooled.T @ g, "out_bias": np.array([g.sum()], np.float32)}
        d_pool = g[:, None] * self.p["out"]
        dh = w[:, :, None] * d_pool
        dw = (h * d_pool).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        grads["score"] = (a * ds[:, :, None]).sum((0, 1))
        da = ds[:, :, None] * self.p["score"] * (1 - a * a)
        grads["attend"] = h.reshape(-1, h.shape[2]).T @ da.reshape(-1, ATTENTION)
        dh = dh + da @ self.p["attend"].T
        dx_a, grads["ahead"] = gru_back(dh[:, :, :HIDDEN], self.p["ahead"], tape_a)
        dx_b, grads["back"] = gru_back(np.ascontiguousarray(dh[::-1, :, HIDDEN:]), self.p["back"], tape_b)
        dx = np.concatenate([dx_a, dx_b[::-1]], 2).reshape(-1, 6 * HIDDEN)
        d_rows = scatter_rows(local.ravel(), dx, len(real) + 1)[:-1]
        grads["in"], grads["in_bias"] = x.T @ d_rows, d_rows.sum(0)
        d_in = d_rows @ self.p["in"].T
        grads["words"] = scatter_rows(ids[real], d_in[:, :WORD_DIM], len(self.p["words"])) + 1e-5 * self.p["words"]
        d_gram = np.repeat(d_in[:, WORD_DIM:] / sub.gram_n[:, None].astype(np.float32), sub.gram_n, 0)
        grads["chars"] = scatter_rows(sub.grams, d_gram, TRIGRAMS) + 1e-5 * self.p["chars"]
        return grads, loss

    def window_logits(self, tokens: Tokens) -> np.ndarray:
        table = self.project(self.inputs(tokens, self.word_ids(tokens.hashes)))
        out = np.empty(len(tokens.text), np.float32)
        for at in range(0, len(out), SCORED):
            out[at : at + SCORED] = self.forward(table, tokens.windows(np.arange(at, min(at + SCORED, len(out)))))[0]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1, one for each text; a text without words is one window without words."""
        if not texts:
            return np.zeros(0)
        tokens = Tokens(texts)
        top = np.maximum.reduceat(self.window_logits(tokens), np.cumsum(tokens.per_text) - tokens.per_text)
        return sigmoid((top - self.shift).astype(np.float64))


class _Sub:
    """Trigrams of some of the distinct words."""

    def __init__(self, tokens: Tokens, real: np.ndarray):
        self.gram_n = tokens.gram_n[real]
        ends = np.cumsum(self.gram_n)
        self.gram_at = ends - self.gram_n
        total = int(ends[-1]) if len(ends) else 0
        self.grams = tokens.grams[np.arange(total) + np.repeat(tokens.gram_at[real] - self.gram_at, self.gram_n)]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0) -> Model:
    """From texts with labels 0 or 1. With one label only, all scores lie on that label's side."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    tokens = Tokens(texts) if texts else None
    n_words = len(tokens.hashes) if texts else 0
    seen = np.zeros((2, n_words))
    for i in range(len(texts)):
        own = np.unique(tokens.which[tokens.low[i] : tokens.high[i]])
        seen[int(labels[i]), own] += 1
    vocab = tokens.hashes[seen.sum(0) >= LEAST_DOCS] if texts else np.zeros(0, np.uint64)
    p = {
        "words": 0.1 * init(rng, len(vocab) + 1, WORD_DIM) * np.sqrt(len(vocab) + 1, dtype=np.float32),
        "chars": 0.1 * init(rng, TRIGRAMS, CHAR_DIM) * np.sqrt(TRIGRAMS, dtype=np.float32),
        "in": init(rng, WORD_DIM + CHAR_DIM, 6 * HIDDEN),
        "in_bias": np.zeros(6 * HIDDEN, np.float32),
        "ahead": init(rng, HIDDEN, 3 * HIDDEN),
        "back": init(rng, HIDDEN, 3 * HIDDEN),
        "attend": init(rng, 2 * HIDDEN, ATTENTION),
        "score": init(rng, ATTENTION),
        "out": init(rng, 2 * HIDDEN),
        "out_bias": np.zeros(1, np.float32),
    }
    model = Model(p, vocab)
    count = np.bincount(labels.astype(int), minlength=2)
    if not count.all():
        model.shift = 30.0 if count[0] or not len(texts) else -30.0
        return model
    odds = np.log((seen[1] + 0.5) / (count[1] + 1)) - np.log((seen[0] + 0.5) / (count[0] + 1))
    # Words start with their odds in one place; training goes on from there.
    ids = model.word_ids(tokens.hashes)
    p["words"][ids[ids > 0], 0] = np.clip(odds[ids > 0], -1, 3)
    weight = np.append(np.clip(np.where(ids > 0, odds, 0), 0, None), 0)
    strength = np.concatenate([weight[tokens.windows(np.arange(a, min(a + 8192, len(tokens.text))))].max(0) for a in range(0, len(tokens.text), 8192)])
    adam = Adam(p, 0.01)
    first = np.cumsum(tokens.per_text) - tokens.per_text
    for _ in range(ROUNDS):
        chosen, target = [], []
        for i, (a, n) in enumerate(zip(first, tokens.per_text)):
            order = a + np.argsort(-strength[a : a + n], kind="stable")
            if labels[i]:
                some = order[:2]
                some = some[: 1 + int(n > 1 and strength[some[-1]] >= 0.9 * strength[some[0]])]
            else:
                some = np.concatenate([order[:2], rng.choice(order, min(4, n), replace=False)])
            chosen.extend(some)
            target.extend([labels[i]] * len(some))
        chosen, target = np.array(chosen), np.array(target, np.float32)
        for epoch in range(EPOCHS):
            adam.rate = 0.01 if epoch < EPOCHS - 3 else 0.003
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                # Now and then a word is known by its characters alone.
                own = np.where(rng.random(len(ids)) < 0.15, 0, ids)
                grads, _ = model.gradients(tokens.windows(chosen[some]), target[some], tokens, own)
                adam.update(grads)
        strength = model.window_logits(tokens)
    top = np.maximum.reduceat(strength, first).astype(np.float64)
    # The cut with the best balanced accuracy on the sample, midway between the texts that it parts.
    order = np.argsort(top)
    gain = np.cumsum(np.where(labels[order] == 1, -1.0 / count[1], 1.0 / count[0]))
    k = int(np.argmax(gain))
    model.shift = float((top[order[k]] + top[order[min(k + 1, len(order) - 1)]]) / 2)
    return model


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``sample`` labelled rows of each label, none of them held out."""
    return labelled(docs, labels, "toxic", lambda: fold() != 0, sample, MOST_CHARS)


def score(df: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of ``df`` (doc_id, text).

    Null and empty texts get the score of a window without words. All windows of texts of any length are scored. Repeated rows
    and null ids stay; an empty frame gives an empty frame; other columns are ignored. The model has a bounded size (its vocabulary comes from the sample) and is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=STEP_BYTES):
            found = shared.value.scores(blobs(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return arrow_map(pick(df, "doc_id", "text"), run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    return train([t.encode() for t, _ in rows], np.array([y for _, y in rows]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay, in the columns of ``documents``. Labels come from the corpus's ``labels``.

    Null and empty texts score as a window without words. Repeated rows and rows without an id are judged by their texts and
    stay or go alike; all windows of texts of any length are scored; an empty frame gives an empty frame.
    """
    model = spark.sparkContext.broadcast(fit(docs, read(spark, sf_dir, "labels")))
    rows = pick(docs, "doc_id", "text", "lang", "source", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=STEP_BYTES):
            yield part.filter(pa.array(model.value.scores(blobs(part.column("text"))) < 0.5))

    return arrow_map(rows, run, "doc_id long, text string, lang string, source string, n_chars long")
