"""Operator 6 against the tokenizers library and its invariants."""
import zlib

import numpy as np
import pytest

from tidemark.llm import packing


def test_pack(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_str(packing.default_tokenizer())
    rng = np.random.default_rng(4)
    texts = [None, "", "  ", "A", "don't STOP é É 12 3 x y <|endoftext|>", "word " * 9000, "x" * 6000] + [" ".join(["lorem"] * int(n)) for n in rng.integers(0, 900, 120)]
    texts += ["".join(rng.choice(list("aE' 1\n\té́😀"), 30)) for _ in range(60)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "null id", 5), (3, "A", 5), (3, "A", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    out = packing.pack(df).collect()
    want = []
    for i, t, _ in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        for start in range(0, len(ids), 4096):
            one = ids[start : start + 4096]
            want.append((i is None, i or 0, start, len(one), zlib.crc32(np.array(one, "<u4").tobytes()), len(ids)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == sorted(want)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_str(packing.default_tokenizer())
    texts = [None, "", "a few words", "word and word " * 3000, "It's 12 o'clock"] * 20
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in packing.op6_packing(spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for start, length, crc, total in sorted(found[i]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()))
            at += length
        assert at == len(ids)


@pytest.mark.parametrize("seed", range(2))
def test_plan_uses_every_count_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(512, 1 + rng.lognormal(4.5, 0.8, 20000).astype(int))
    histogram = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    chosen = packing.plan(histogram, 512)
    used = {}
    for pattern, times in chosen:
        assert sum(s * n for s, n in pattern.items()) <= 512 and times > 0
        for s, n in pattern.items():
            used[s] = used.get(s, 0) + n * times
    assert used == histogram
    total = sum(times for _, times in chosen)
    assert total * 512 <= 1.01 * sizes.sum() + 1024


def test_words_match_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_str(packing.default_tokenizer())
    rng = np.random.default_rng(16)
    bits = list("abcdefghinorstuxyzABCTHÉéßñüöΣσİıœ漢字語0123456789½²'\"!?.,;:-_/|%$&*#@()[]<>=+~\u0301\u0331\u00a0\u2003\u200d\x01\x85") + ["the", "tion", "'s", "'LL", "😀", "ing", "<|endoftext|>", "ΟΔΟΣ"]
    words = ["".join(rng.choice(bits, int(rng.integers(1, 12)))) for _ in range(20000)] + ["x" * 4000, "!" * 3000, "ab" * 3000]
    made = packing.Words(packing.default_tokenizer())
    for w, got in zip(words, made.ids([w.encode() for w in words])):
        assert np.frombuffer(got, "<u4").tolist() == own.encode(w, add_special_tokens=False).ids, repr(w)


def test_odd_words_alone_first_and_in_batches():
    """Ids of a word depend neither on its batch nor on what the worker saw before."""
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_str(packing.default_tokenizer())
    spec = packing.default_tokenizer()
    odd = ["\u3000", "\u00a0", "\u2028", "\u2003", "\u00a0\u2028", "\u1680\u205f", "\u0301", "\u200d", "\x85", "\x01", "é", "abc", "\u3000abc", "abc\u3000", "a\u2003b", "<|endoftext|>", "Σ", "'s", "\ufeff", "\u180e"]
    right = {w: own.encode(w, add_special_tokens=False).ids for w in odd}
    of = lambda made, texts: [np.frombuffer(x, "<u4").tolist() for x in made.ids([t.encode() for t in texts])]
    once = packing.Words(spec)
    for w in odd:  # each is the only new word of its batch
        assert of(once, [w]) == [right[w]], repr(w)
    assert of(once, ["abc", "abc \u3000 abc"]) == [own.encode(t, add_special_tokens=False).ids for t in ("abc", "abc \u3000 abc")]
    rng = np.random.default_rng(9)
    for first in odd:
        once.known.clear()
        once.known.update(once.added)
        assert of(once, [first]) == [right[first]]
        for _ in range(4):
            texts = [" ".join(rng.choice(odd, int(rng.integers(1, 5)))) for _ in range(int(rng.integers(1, 4)))]
            assert of(once, texts) == [own.encode(t, add_special_tokens=False).ids for t in texts], texts


def test_shuffled_input_gives_equal_ids(spark):
    rng = np.random.default_rng(11)
    bits = ["\u3000", "abc", "\u2003", "déjà", "word", "\u00a0\u2028", "12"]
    rows = [(i, " ".join(rng.choice(bits, int(rng.integers(0, 4))))) for i in range(300)]
    found = []
    for seed in (1, 2):
        order = np.random.default_rng(seed).permutation(len(rows))
        df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(3 + seed)
        found.append(sorted(map(tuple, packing.pieces(df).collect())))
    assert found[0] == found[1]


def test_long_classes_take_more_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTS", 2)
    monkeypatch.setattr(packing, "RUN", 5)
    df = spark.createDataFrame([(i, "a b c") for i in range(100)] + [(200 + i, "word " * 30) for i in range(7)], "doc_id long, text string")
    out = packing.pack(df).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 107 == len(out)
    assert {r.sequence_id for r in out} == set(range(1 + max(r.sequence_id for r in out)))


def test_knapsack_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        values = rng.random(6) * np.arange(1, 7)
        best = {0: 0.0}
        for room in range(1, 20):
            best[room] = max([best[room - 1], *(best[room - s] + values[s - 1] for s in range(1, 7) if s <= room)])
        worth, pattern = packing.knapsack(values, 19)
        assert abs(worth - best[19]) < 1e-9 and sum(s * n for s, n in pattern.items()) <= 19
        assert abs(sum(values[s - 1] * n for s, n in pattern.items()) - worth) < 1e-9


def test_plan_small():
    assert packing.plan({}, 512) == []
    assert packing.plan({512: 3}, 512) == [({512: 1}, 3)]
    chosen = packing.plan({300: 2, 200: 2, 12: 2}, 512)
    assert sum(t for _, t in chosen) == 2
