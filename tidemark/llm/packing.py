"""Operator 6, packing: cutting-stock column generation over a histogram of lengths.

Documents are tokenized; whole sequences of tokens are cut off first, and what is left of each document is counted by length
class (a fixed number of classes, so the histogram is bounded however many documents there are). A linear program chooses
patterns of classes; a knapsack dynamic program prices new patterns until the bound says that little is left to win. Patterns
are rounded down, the rest is filled first-fit decreasing, and documents, ranked within their class, take the slots.
"""
from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import arrow_map, blobs, cut, pick, read, slices

CAPACITY = 4096
END_ID = 2
#: Lengths are rounded up to this many tokens for the program: CAPACITY // GRID classes.
GRID = 8
#: The linear program stops at this relative distance from its lower bound.
GAP = 0.001
#: Ranks within a class are counted in salted runs, so one common length isn't ranked in one task: SALTS, or more of RUN pieces.
SALTS, RUN = 64, 1 << 20
#: Bytes of words and ids that a worker remembers, with what an entry costs besides; beyond them it forgets all.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 150

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


class Words:
    """Token ids of texts, word by word: the tokenizer's matches never reach over white space.

    Words are normalised and split as the tokenizer does; its merges run in tiktoken, many words at a time. The mark of a
    word's end becomes the byte 0, merged with the byte before it at first, as the ranks of those pairs are the lowest. Words
    with control characters go to the tokenizer itself. Added tokens in a text part what stands around them and have their own
    ids, as in the library.
    """

    END = "\0"

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        plain = json.loads(spec)
        self.added = {t["content"].encode(): np.array([t["id"]], "<u4").tobytes() for t in plain["added_tokens"]}
        self.known: dict[bytes, bytes] = dict(self.added)
        self.held = 0
        self.part = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or rb"(?!)")
        pattern = plain["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(f"{pattern}|\\n").findall
        suffix = plain["model"]["end_of_word_suffix"]
        special = {t["id"] for t in plain["added_tokens"]}
        # The alphabet of byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {}
        for token, i in plain["model"]["vocab"].items():
            if i not in special:
                tail = token.endswith(suffix)
                ranks[bytes(byte_of[c] for c in token.removesuffix(suffix)) + b"\0" * tail] = i
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n\0"]
        self.odd = re.compile(rb"[\x00-\x1f\x7f]|\xc2[\x80-\x9f]")

    def _learn(self, new: list[bytes]) -> None:
        if self.odd.search(b" ".join(new)):
            odd = [w for w in new if self.odd.search(w)]
            for w, e in zip(odd, self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in odd], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
            new = [w for w in new if not self.odd.search(w)]
        if not new:
            return
        # Letters are lowered one by one: a sigma that ends a word is no exception.
        text = unicodedata.normalize("NFC", b"\n".join(new).decode("utf-8", "replace")).replace("Σ", "σ").lower()
        found = self.find(text)  # nothing, not even an end, where the only word is white space outside ASCII
        ids = self.merges.encode_to_numpy(self.END.join(found) + self.END, disallowed_special=()).astype("<u4") if found else np.zeros(0, "<u4")
        ends = [*np.flatnonzero(ids == self.line).tolist(), len(ids)]
        raw, at = ids.tobytes(), 0
        for w, end in zip(new, ends, strict=True):
            self.known[w] = raw[4 * at : 4 * end]
            at = end + 1

    def _split(self, text: bytes) -> list[bytes]:
        if not self.part.search(text):
            return text.split()
        out, at = [], 0
        for m in self.part.finditer(text):
            out += [*text[at : m.start()].split(), m[0]]
            at = m.end()
        return out + text[at:].split()

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [self._split(t) for t in texts]
        known = self.known
        if self.held > CACHE_BYTES:
            known.clear()
            known.update(self.added)
            self.held = 0
        new = list(set().union(*words).difference(known))
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        self.held += sum(ENTRY_BYTES + len(w) + len(known[w]) for w in new)
        for ws in words:
            yield b"".join(map(known.__getitem__, ws))


_words: dict[int, Words] = {}


def pieces(df: DataFrame, spec: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each row of ``df`` (doc_id, text): whole sequences, then what is left, if anything.

    Null and empty texts are the end id alone. Repeated rows and null ids stay; other columns are ignored. Texts of any length
    are tokenized whole; ids of a word never depend on the words around it. An empty frame has no pieces.
    """
    spec = spec or default_tokenizer()
    key = zlib.crc32(spec.encode())
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _words:
            _words.clear()
            _words[key] = Words(shared.value)
        words, end = _words[key], np.array([END_ID], "<u4").tobytes()
        for part in slices(batches):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), words.ids(blobs(part.column("text")))):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    one = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(one) // 4, zlib.crc32(one), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in PIECES.split(", ")])

    return arrow_map(pick(df, "doc_id", "text"), run, PIECES)


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Best total value of sizes 1..len(values), any number of each, within ``capacity``."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        n = min(room, len(values))
        options = best[room - n : room][::-1] + values[:n]  # size 1 leaves room - 1
        k = int(options.argmax())
        if options[k] > best[room - 1]:
            best[room], took[room] = options[k], k + 1
        else:
            best[room] = best[room - 1]
    pattern: dict[int, int] = {}
    room = capacity
    while room > 0:
        if took[room]:
            pattern[int(took[room])] = pattern.get(int(took[room]), 0) + 1
            room -= int(took[room])
        else:
            room -= 1
    return float(best[capacity]), pattern


def relax(demand: dict[int, int], units: int, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """Column generation for the cutting-stock relaxation: patterns with how often each is used."""
    sizes = sorted(demand)
    row = {s: i for i, s in enumerate(sizes)}
    need = np.array([demand[s] for s in sizes], float)
    basis = [{s: units // s} for s in sizes]
    inverse = np.diag([s_ / units if units % s_ == 0 else 1.0 / (units // s_) for s_ in sizes])
    use = inverse @ need
    for _ in range(50 * len(sizes)):
        duals = inverse.sum(axis=0)
        values = np.zeros(sizes[-1])
        values[np.array(sizes) - 1] = np.maximum(duals, 0)
        worth, pattern = knapsack(values, units)
        if worth <= 1 + gap:  # the optimum is at least the present total over worth
            break
        column = np.zeros(len(sizes))
        for s, n in pattern.items():
            column[row[s]] = n
        change = inverse @ column
        can = change > 1e-9
        if not can.any():
            break
        ratio = np.full(len(sizes), np.inf)
        ratio[can] = use[can] / change[can]
        out = int(ratio.argmin())
        step = ratio[out]
        use -= step * change
        use[out] = step
        np.maximum(use, 0, out=use)
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
        basis[out] = pattern
    return list(zip(basis, use.tolist()))


def plan(histogram: dict[int, int], units: int = CAPACITY // GRID) -> list[tuple[dict[int, int], int]]:
    """Patterns (size in units: how many) with how many sequences each makes; every size's count is used up exactly."""
    left = {s: n for s, n in histogram.items() if n > 0}
    chosen: list[tuple[dict[int, int], int]] = []
    if full := left.pop(units, 0):
        chosen.append(({units: 1}, full))
    if left:
        for pattern, times in relax(left, units):
            times = min([int(times + 1e-6), *(left.get(s, 0) // n for s, n in pattern.items())])
            if times > 0:
                chosen.append((pattern, times))
                for s, n in pattern.items():
                    left[s] -= n * times
    # What rounding left over, first-fit decreasing: best sizes first, the fullest sequence that has room.
    while any(left.values()):
        room, pattern = units, {}
        for s in sorted((s for s, n in left.items() if n), reverse=True):
            n = min(left[s], room // s)
            if n:
                pattern[s] = n
                room -= n * s
        times = min(left[s] // n for s, n in pattern.items())
        chosen.append((pattern, times))
        for s, n in pattern.items():
            left[s] -= n * times
    return chosen


class Slots:
    """Which sequence and place the k-th piece of a class takes."""

    def __init__(self, chosen: list[tuple[dict[int, int], int]]):
        by: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for pattern, times in chosen:
            for s, n in pattern.items():
                by.setdefault(s, []).append((n, times, first))
            first += times
        self.total = first
        self.by = {}
        for s, rows in by.items():
            n, times, base = (np.array(c, np.int64) for c in zip(*rows))
            self.by[s] = (np.cumsum(n * times), n, base)

    def place(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, per, base = self.by[size]
        k = np.searchsorted(ends, ranks, side="right")
        within = ranks - np.concatenate([[0], ends])[k]
        return base[k] + within // per[k], within % per[k]


def pack(df: DataFrame, spec: str | None = None, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """Every piece of ``pieces`` with its sequence_id and the offset of its first id there, gapless from 0.

    Each id lies in exactly one piece; a sequence holds ``capacity`` ids at most. Null and empty texts are the end id alone, a
    very long text is many pieces, equal pieces of repeated rows take places of their own in no stated order, and rows without
    an id are packed like others. The driver holds the histogram (capacity / grid classes), the plan made from it and a number
    for each salted run of pieces, of which none has more than about RUN. An empty frame has no pieces.
    """
    spark = df.sparkSession
    size = F.ceil(F.col("length") / grid).cast("long")
    cutoff = cut(pieces(df, spec, capacity)).withColumn("size", size)
    classes = {r["size"]: r["count"] for r in cutoff.groupBy("size").count().collect()}
    runs = F.lit(SALTS)
    for k, n in classes.items():
        if n > SALTS * RUN:
            runs = F.when(F.col("size") == k, F.lit(-(-n // RUN))).otherwise(runs)
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), runs)
    salted = cutoff.withColumn("salt", salt)
    held = salted.groupBy("size", "salt").agg(F.count("*").alias("n")).collect()
    histogram: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(held):
        before[r["size"], r["salt"]] = histogram.get(r["size"], 0)
        histogram[r["size"]] = histogram.get(r["size"], 0) + r["n"]
    slots = spark.sparkContext.broadcast((Slots(plan(histogram, capacity // grid)), before))
    order = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1)
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, start = slots.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, salts, ranks = (batch.column(c).to_numpy() for c in ("size", "salt", "rank"))
            seq, slot = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes).tolist():
                at = sizes == s
                shift = np.array([start[s, k] for k in salts[at].tolist()], np.int64)
                seq[at], slot[at] = table.place(s, ranks[at] + shift)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(-sizes), pa.array(slot)], names=[*names, "sequence_id", "big", "slot"])

    placed = arrow_map(ranked.select(*names, "size", "salt", "rank"), run, f"{PIECES}, sequence_id long, big long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("big", "slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")
    return placed.withColumn("offset", offset).select(*names, "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed: the rows of ``pack``, which says what null, empty, long and repeated texts and empty frames give."""
    return pack(docs)
