"""Operator 3, personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions on top.

The network is trained in numpy from labelled spans: documents of a bounded sample, labelled by the base patterns, and made-up
values in their text, labelled as written. Overlapping windows cover every character of every text, and all of them are decoded
by Viterbi; a character's tag is that of the window in whose middle it lies nearest; runs of a tag become spans. Base spans
always stay; spans of the network that touch none of them are added.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, blobs, lowest, pick, read, slices
from ._nets import Adam, LstmReader, init, lstm, lstm_back, scatter_rows

#: Kinds in the order in which spans of one start are listed; tags are 0 for none, then these.
KINDS = ("email", "ip", "card", "phone")
TAGS = 5
#: Characters of a window that is decoded, how far the next one begins, and characters of one that is trained on.
WINDOW, STRIDE, TRAINED = 160, 128, 64
HIDDEN, DIM, VOCAB = 12, 12, 130
#: Documents that training reads at most, the length of the longest, and the windows that are made up.
SAMPLE, MOST_CHARS, MADE_UP = 300, 6000, 2500
EPOCHS, BATCH = 10, 64
#: Windows decoded at once.
DECODED = 1024
#: Least characters, and least and most digits, of an added span.
LEAST_CHARS = {"email": 6, "ip": 7, "card": 12, "phone": 9}
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 9}
MOST_DIGITS = {"email": 10**9, "ip": 12, "card": 19, "phone": 15}

Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at sign outwards, so long words without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                yield m.span()


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, k, b) for k, find in ((1, _ips), (2, _cards), (3, _phones)) for a, b in find(text)]
    return sorted(out)


def points(text: str) -> np.ndarray:
    """Character numbers: ASCII as it is, all others alike."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 128).astype(np.uint8)


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags: emit (T, tags, B), trans (from, to). Of equal ones, the lowest tag."""
    steps, tags, rows = emit.shape
    score, some = np.empty_like(emit), np.empty((tags, tags, rows), emit.dtype)
    score[0] = emit[0]
    step = np.ascontiguousarray(trans, emit.dtype)[:, :, None]
    for t in range(1, steps):
        np.add(score[t - 1][:, None, :], step, out=some)
        np.max(some, axis=0, out=score[t])
        score[t] += emit[t]
    out = np.empty((steps, rows), np.int8)
    out[-1] = score[-1].argmax(0)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = (score[t - 1] + step[:, out[t], 0]).argmax(0)
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def crf(emit: np.ndarray, tags: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of ``tags`` (T, B), and its gradients in emissions and transitions."""
    steps, rows, n = emit.shape
    emit = emit.astype(np.float64)
    ahead, back = np.empty_like(emit), np.zeros_like(emit)
    ahead[0] = emit[0]
    for t in range(1, steps):
        ahead[t] = _logsum(ahead[t - 1][:, :, None] + trans, 1) + emit[t]
    for t in range(steps - 2, -1, -1):
        back[t] = _logsum(trans[None] + (emit[t + 1] + back[t + 1])[:, None, :], 2)
    z = _logsum(ahead[-1], 1)
    d_emit = np.exp(ahead + back - z[:, None])
    d_trans = np.zeros((n, n))
    for t in range(1, steps):
        d_trans += np.exp(ahead[t - 1][:, :, None] + trans + (emit[t] + back[t])[:, None, :] - z[:, None, None]).sum(0)
    t_, b_ = np.arange(steps)[:, None], np.arange(rows)
    gold = emit[t_, b_, tags].sum(0) + trans[tags[:-1], tags[1:]].sum(0)
    d_emit[t_, b_, tags] -= 1
    np.add.at(d_trans, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    return float((z - gold).mean()), (d_emit / rows).astype(np.float32), (d_trans / rows).astype(np.float32)


class Tagger:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    def emissions(self, chars: np.ndarray, keep: bool = False):
        """chars: (T, B); (T, B, tags)."""
        table = self.p["chars"] @ self.p["in"] + self.p["in_bias"]
        x = table[chars]
        ahead, tape_a = lstm(x[:, :, : 4 * HIDDEN], self.p["ahead"], keep)
        back, tape_b = lstm(x[::-1, :, 4 * HIDDEN :], self.p["back"], keep)
        h = np.concatenate([ahead, back[::-1]], 2)
        return h @ self.p["out"] + self.p["out_bias"], (h, tape_a, tape_b)

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[dict, float]:
        emit, (h, tape_a, tape_b) = self.emissions(chars, True)
        loss, d_emit, d_trans = crf(emit, tags, self.p["trans"].astype(np.float64))
        grads = {"trans": d_trans, "out": h.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, TAGS), "out_bias": d_emit.sum((0, 1))}
        dh = d_emit @ self.p["out"].T
        dx_a, grads["ahead"] = lstm_back(dh[:, :, :HIDDEN], self.p["ahead"], tape_a)
        dx_b, grads["back"] = lstm_back(dh[::-1, :, HIDDEN:], self.p["back"], tape_b)
        dx = np.concatenate([dx_a, dx_b[::-1]], 2).reshape(-1, 8 * HIDDEN)
        rows = scatter_rows(chars.ravel(), dx, VOCAB)
        grads["in"], grads["in_bias"], grads["chars"] = self.p["chars"].T @ rows, rows.sum(0), rows @ self.p["in"].T
        return grads, loss

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """Tags of windows: chars (T, B)."""
        if not hasattr(self, "readers"):
            table = self.p["chars"] @ self.p["in"] + self.p["in_bias"]
            self.readers = [LstmReader(table[:, : 4 * HIDDEN], self.p["ahead"]), LstmReader(table[:, 4 * HIDDEN :], self.p["back"])]
            self.states = np.empty((2, 0, 0, HIDDEN), np.float32)
        steps, rows = chars.shape
        if self.states.shape[1:3] != (steps, rows):
            self.states = np.empty((2, steps, rows, HIDDEN), np.float32)
        symbols = chars.astype(np.intp)
        for k, reader in enumerate(self.readers):
            reader.read(symbols, self.states[k], k == 1)
        ahead, back = self.states.reshape(2, -1, HIDDEN)
        emit = (ahead @ self.p["out"][:HIDDEN] + back @ self.p["out"][HIDDEN:] + self.p["out_bias"]).reshape(steps, rows, TAGS)
        return viterbi(np.ascontiguousarray(emit.transpose(0, 2, 1)), self.p["trans"])

    def __getstate__(self) -> dict:
        return {"p": self.p}

    def tags(self, chars: np.ndarray) -> np.ndarray:
        """A tag for each character of a text of any length."""
        return self.tags_of([chars])[0]

    def tags_of(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Windows of all texts are decoded together, DECODED at a time; each gives the tags of the characters that have it nearest."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint8), *texts])
        ends = np.cumsum(sizes)
        count = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
        owner = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = (ends - sizes)[owner] + place * STRIDE
        end = ends[owner]
        # Where two windows overlap, each has half; text ends are no window's edge.
        edge = (WINDOW - STRIDE) // 2
        low = begin + np.where(place > 0, edge, 0)
        high = np.where(place < count[owner] - 1, begin + WINDOW - edge, end)
        out = np.empty(len(flat), np.int8)
        for a in range(0, len(owner), DECODED):
            some = slice(a, a + DECODED)
            at = begin[some] + np.arange(WINDOW)[:, None]
            inside = at < end[some]
            tags = self.decode(np.where(inside, flat[np.minimum(at, len(flat) - 1)], VOCAB - 1))
            own = inside & (at >= low[some]) & (at < high[some])
            out[at[own]] = tags[own]
        return np.split(out, ends[:-1]) if len(texts) else []


def spans_of(text: str, tags: np.ndarray) -> list[Span]:
    """Runs of a tag, without white space and marks at their ends, if they have characters and digits enough."""
    if not tags.any():
        return []
    edge = np.flatnonzero(np.concatenate([[True], tags[1:] != tags[:-1], [True]]))
    out = []
    for a, b in zip(edge[:-1], edge[1:]):
        kind = int(tags[a]) - 1
        if kind < 0:
            continue
        a, b = int(a), int(b)
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        name = KINDS[kind]
        digits = len(_DIGITS.sub("", text[a:b]))
        if b - a >= LEAST_CHARS[name] and LEAST_DIGITS[name] <= digits <= MOST_DIGITS[name] and (digits or "@" in text[a:b]) and (name != "email" or "@" in text[a:b]):
            out.append((a, kind, b))
    return out


def reconcile(base: list[Span], found: list[Span]) -> list[Span]:
    """Base spans, and those found that touch none of them, by start and kind."""
    starts = np.array([s[0] for s in base], np.int64)
    reach = np.maximum.accumulate(np.array([s[2] for s in base], np.int64)) if base else starts
    added = []
    for s in found:
        k = int(np.searchsorted(starts, s[2], "left"))  # base spans that start before its end
        if not k or reach[k - 1] <= s[0]:
            added.append(s)
    return sorted(base + added)


def made_up(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A line of words with one or two made-up values, some in forms that the base patterns miss, and decoys."""
    letters, digits = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")
    word = lambda a=2, b=9: "".join(rng.choice(letters, int(rng.integers(a, b))))
    num = lambda n: "".join(rng.choice(digits, n))

    def card() -> str:
        body = str(rng.choice(["4", "5", "37"])) + num(13)
        body = body[:15]
        check = next(c for c in "0123456789" if luhn(body + c))
        sep = str(rng.choice(["", "", " ", "-", "."]))
        whole = body + check
        return sep.join(whole[k : k + 4] for k in range(0, 16, 4))

    def value(kind: int) -> str:
        if kind == 0:
            at = str(rng.choice(["@", "@", "@", " @ "]))
            return f"{word()}{rng.choice(['', '.', '_'])}{word()}{num(int(rng.integers(0, 3)))}{at}{word()}{num(int(rng.integers(0, 2)))}.{rng.choice(['com', 'org', 'net', 'example.com', 'de'])}"
        if kind == 1:
            return ".".join(str(int(k)) for k in rng.integers(1, 255, 4))
        if kind == 2:
            return card()
        a, b, c = num(3), num(3), num(4)
        return str(rng.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"+4{num(1)} {num(2)} {num(7)}", f"{a}-{b}-{c}"]))

    def decoy() -> str:
        return str(rng.choice([num(int(rng.integers(1, 7))), f"{num(2)}.{num(1)}", f"20{num(2)}-{num(2)}-{num(2)}", word() + num(2), "v" + num(1) + "." + num(1) + "." + num(1), f"{num(24)}", f"#{num(4)}", "".join(rng.choice(list("0123456789abcdef"), 32))]))

    text, spans = "", []
    for _ in range(int(rng.integers(1, 4))):
        if not spans or rng.random() < 0.7:  # now and then values stand side by side
            text += " ".join([word() for _ in range(int(rng.integers(1, 4)))]) + " "
        if rng.random() < 0.3:
            text += decoy() + " "
        else:
            kind = int(rng.integers(0, 4))
            v = value(kind)
            spans.append((len(text), kind, len(text) + len(v)))
            text += v + str(rng.choice([" ", " ", ", ", ". "]))
    return text + word(), spans


def train(texts: list[str], seed: int = 0) -> Tagger:
    """From labelled spans: the base spans of ``texts``, and made-up lines."""
    rng = np.random.default_rng(seed)
    p = {
        "chars": init(rng, VOCAB, DIM) * np.sqrt(VOCAB / DIM, dtype=np.float32),
        "in": init(rng, DIM, 8 * HIDDEN),
        "in_bias": np.zeros(8 * HIDDEN, np.float32),
        "ahead": init(rng, HIDDEN, 4 * HIDDEN),
        "back": init(rng, HIDDEN, 4 * HIDDEN),
        "out": init(rng, 2 * HIDDEN, TAGS),
        "out_bias": np.zeros(TAGS, np.float32),
        "trans": np.zeros((TAGS, TAGS), np.float32),
    }
    p["in_bias"][HIDDEN : 2 * HIDDEN] = p["in_bias"][5 * HIDDEN : 6 * HIDDEN] = 1  # forget gates start open
    chars, tags = [], []

    def add(text: str, spans: list[Span], starts: list[int]) -> None:
        c, t = points(text), np.zeros(len(text), np.int64)
        for a, kind, b in spans:
            t[a:b] = kind + 1
        for s in starts:
            row, mark = np.full(TRAINED, VOCAB - 1, np.int64), np.zeros(TRAINED, np.int64)
            row[: len(c[s : s + TRAINED])] = c[s : s + TRAINED]
            mark[: len(c[s : s + TRAINED])] = t[s : s + TRAINED]
            chars.append(row)
            tags.append(mark)

    for text in texts:
        spans = base_spans(text)
        add(text, spans, [max(0, a - int(rng.integers(0, TRAINED))) for a, _, _ in spans[:8]] + [int(rng.integers(0, max(1, len(text) - TRAINED)))])
    for _ in range(MADE_UP):
        text, spans = made_up(rng)
        add(text, spans, [int(rng.integers(0, max(1, len(text) - TRAINED)))])
    chars, tags = np.array(chars).T, np.array(tags).T
    model, adam = Tagger(p), Adam(p, 0.01)
    for epoch in range(EPOCHS):
        adam.rate = 0.01 if epoch < EPOCHS - 2 else 0.003
        order = rng.permutation(chars.shape[1])
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            adam.update(model.gradients(chars[:, some], tags[:, some])[0])
    return model


def fit(docs: DataFrame) -> Tagger:
    """On the ``SAMPLE`` documents with a digit or an at sign that have the lowest hash, among those not too long."""
    rows = pick(docs, "doc_id", "text").filter(F.length("text") <= MOST_CHARS).filter(F.col("text").rlike("[0-9@]"))
    sample = lowest(rows, ["doc_id", "text"], SAMPLE).orderBy("h", "doc_id", "text").limit(SAMPLE).select("text").collect()
    return train([r.text for r in sample])


def find(df: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, base and all (arrays of start, kind, end) for each row of ``df`` (doc_id, text).

    Null text counts as empty and has no spans. Repeated rows and null ids stay; other columns are ignored. Places are code
    points, ends exclusive. Texts of any length are taken whole, an empty frame gives an empty frame; the network has a fixed size
    and is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<start:long,kind:string,end:long>>"
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    say = lambda spans: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            base, full = zip(*all_spans([t.decode("utf-8", "replace") for t in blobs(part.column("text"))], shared.value))
            cols = [part.column("doc_id"), pa.array(map(say, base), arrow), pa.array(map(say, full), arrow)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "base", "full"])

    return arrow_map(pick(df, "doc_id", "text"), run, f"doc_id long, base {kind}, full {kind}")


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    return [(b, reconcile(b, spans_of(t, tags))) for b, t, tags in zip(base, texts, model.tags_of([points(t) for t in texts]))]


def _say(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    count = lambda name: F.size(F.filter("base", lambda x: x["kind"] == name)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(_say(F.col("base")), 256).alias("base_sha256"), _say(F.col("full")).alias("spans"), F.size("full").cast("long").alias("n_spans"))


def mask(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind; where spans overlap, their union by the kind of the first."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` and ``<PHONE>``.

    Null texts stay null and empty ones empty, repeated rows stay rows of their own, texts of any length are masked whole; an
    empty frame gives an empty frame, and columns other than those of ``documents`` go.
    """
    model = spark.sparkContext.broadcast(fit(docs))
    rows = pick(docs, "doc_id", "text", "lang", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            given = part.column("text").to_pylist()
            texts = [mask(t or "", full) for t, (_, full) in zip(given, all_spans([t or "" for t in given], model.value))]
            text = pa.array([None if g is None else t for g, t in zip(given, texts)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), text, part.column("lang"), part.column("source"), pa.compute.utf8_length(text).cast(pa.int64())],
                names=["doc_id", "text", "lang", "source", "n_chars"],
            )

    return arrow_map(rows, run, "doc_id long, text string, lang string, source string, n_chars long")
