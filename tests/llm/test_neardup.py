"""Operator 10 against all pairs."""
import re

import numpy as np

from tidemark.llm import neardup


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, threshold):
    sets = [(i, brute_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i is None, i or 0, len(s), find(i) if i is not None else None) for i, s in sets)


def make(rng, n_groups=12, copies=14):
    vocab = [f"w{k}" for k in range(3000)]
    rows, doc = [], 0
    for g in range(n_groups):
        base = list(rng.choice(vocab, int(rng.integers(20, 120))))
        for _ in range(copies):
            text = list(base)
            for _ in range(int(rng.integers(0, 5))):
                text[int(rng.integers(len(text)))] = str(rng.choice(vocab))
            rows.append((doc * 7919 % 100003, " ".join(text)))
            doc += 1
    rows += [(200000 + k, " ".join(rng.choice(vocab, 60))) for k in range(30)]
    return rows


def check(spark, rows, threshold=85):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string").repartition(3)
    out = neardup.near_duplicates(df, threshold).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in out) == brute(rows, threshold)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_components_match_all_pairs(spark):
    rows = make(np.random.default_rng(6))
    odd = [(300000, None), (300001, ""), (300002, "  \n"), (300003, "a b"), (300004, "A\tB"), (300005, "b a"), (None, "a b"), (300006, "long " * 20000), (300007, "LONG " * 19999 + "long")]
    check(spark, rows + odd + rows[:3])


def test_blocks_of_probes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PROBES", 3)
    monkeypatch.setattr(neardup, "RUN", 2)
    check(spark, make(np.random.default_rng(7), 3, 30))


def test_sizes_at_the_edge_of_their_classes(spark):
    """Subsets that are linked by a hair, at many sizes: no size class parts them."""
    rows, doc = [], 0
    for k, n in enumerate([*range(17, 120, 3), 340, 680]):
        words = [f"g{k}x{j}" for j in range(n + 4)]
        for m in (-(-85 * n // 100), -(-85 * n // 100) - 1, n):
            rows.append((doc, " ".join(words[: m + 4])))
            doc += 1
    check(spark, rows)


def test_large_classes(spark):
    """Classes with most of the rows go by the broadcast table, small ones by the shuffle."""
    rng = np.random.default_rng(11)
    a, b = (" ".join(rng.choice([f"w{k}" for k in range(500)], 40)) for _ in range(2))
    check(spark, [(k, a) for k in range(200, 60, -1)] + [(k, b) for k in range(300, 400)] + [(500, a + " more"), *make(rng, 3, 4)][:40])


def test_stage_on_repeated_rows_and_rows_without_an_id(spark):
    text, other = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, text), (1, text), (None, text), (None, other), (None, other), (2, text + " x"), (3, None), (3, None), (None, None), (None, ""), (4, "few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in neardup.stage(spark, docs, "").collect()))
    nameless = [(True, 0, ""), (True, 0, ""), (True, 0, text), (True, 0, other), (True, 0, other)]
    assert out == [(False, 1, text), (False, 1, text), (False, 3, ""), (False, 3, ""), (False, 4, "few words"), *nameless]


def test_recall_against_all_rows(spark):
    """Queries are the rows whose id is divisible by 100: each link to any row at the threshold is found."""
    rng = np.random.default_rng(12)
    rows = [(k, t) for k, (_, t) in enumerate(make(rng, 40, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    sets = [brute_set(t) for _, t in rows]
    links = [(q, j) for q in range(0, len(rows), 100) for j in range(len(rows)) if j != q and 100 * len(sets[q] & sets[j]) >= 85 * len(sets[q] | sets[j])]
    assert len(links) > 10 and all(root[a] == root[b] for a, b in links)


def test_repeated_id_with_other_texts_is_one_document(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    check(spark, [(5, a), (5, b), (6, a), (7, b), (8, "z z z z z z")])


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes_and_sketch():
    rng = np.random.default_rng(8)
    assert neardup.word_hashes(b" \n").tolist() == []
    h = neardup.word_hashes(b"  The\tthe THE\x0bcat the")
    assert h[0] == h[1] == h[2] == h[4] != h[3]
    for n in (1, 3, 40, 2000):
        x = neardup.mix(rng.integers(0, 2**63, n).astype(np.uint64))
        s = neardup.sketch(x, 150)
        # The definition, round by round.
        want, full = np.zeros(150, np.uint64), np.zeros(150, bool)
        for r in range(300):
            hh = neardup.mix(x ^ neardup.mix(np.full(1, r + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            at = (hh >> np.uint64(40)) % np.uint64(150) if r < 150 else np.full(n, r - 150, np.uint64)
            for b, v in zip(at.tolist(), (neardup.mix(hh) >> np.uint64(16)).tolist()):
                key = np.uint64(r << 48 | v)
                if not full[b] or key < want[b]:
                    want[b], full[b] = key, True
        assert s.tolist() == want.tolist()
    same = []
    for _ in range(40):
        x = neardup.mix(rng.integers(0, 2**63, 200).astype(np.uint64))
        same.append((neardup.sketch(x[:180], 150) == neardup.sketch(x[20:], 150)).mean())
    assert abs(np.mean(same) - 0.8) < 0.02
