"""Operator 3: base patterns against plain regular expressions, the CRF against enumeration, held-out spans."""
import hashlib
import itertools
import re

import numpy as np
import pytest

from tidemark.llm import pii


def plain(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans():
    rng = np.random.default_rng(13)
    bits = ["a", "b.c", "@", "x.y", "x.y.z", " ", "12", "255.", "256", ".1", "4921758104870150", "0", "+1 (434) 555-7062", "+", "(", "-", "é", "@@", "a@b@c.d", "0001.2.3.4", "4", "\n", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(bits, int(rng.integers(1, 12))))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("x" * 100000 + "@") == []


def test_crf_and_viterbi_match_enumeration():
    rng = np.random.default_rng(14)
    emit, trans, tags = rng.standard_normal((4, 2, 5)), rng.standard_normal((5, 5)), rng.integers(0, 5, (4, 2))
    loss, d_emit, d_trans = pii.crf(emit, tags, trans)
    paths = list(itertools.product(range(5), repeat=4))
    score = lambda e, p: sum(e[t, k] for t, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
    want = np.mean([np.log(sum(np.exp(score(emit[:, b], p)) for p in paths)) - score(emit[:, b], tags[:, b]) for b in range(2)])
    assert abs(loss - want) < 1e-9
    best = pii.viterbi(emit.transpose(0, 2, 1), trans)
    for b in range(2):
        assert tuple(best[:, b]) == max(paths, key=lambda p: score(emit[:, b], p))
    for array, grad in ((emit, d_emit), (trans, d_trans)):
        for i in range(0, array.size, 3):
            old = array.flat[i]
            array.flat[i] = old + 1e-5
            up = pii.crf(emit, tags, trans)[0]
            array.flat[i] = old - 1e-5
            down = pii.crf(emit, tags, trans)[0]
            array.flat[i] = old
            assert abs((up - down) / 2e-5 - grad.flat[i]) < 1e-4


@pytest.fixture(scope="module")
def model():
    return pii.train(["mail me at abc.de@mail.example.com or 10.20.30.40 now", "no data here"])


def test_held_out_spans(model):
    rng = np.random.default_rng(99)
    hit = total = wrong = 0
    for _ in range(400):
        text, spans = pii.made_up(rng)
        _, full = pii.all_spans([text], model)[0]
        total += len(spans)
        hit += sum(any(k == k2 and a2 < b and a < b2 for a2, k2, b2 in full) for a, k, b in spans)
        wrong += sum(not any(a2 < b and a < b2 for a2, _, b2 in spans) for a, _, b in full)
    assert hit > 0.93 * total and wrong < 0.05 * total
    # Forms that the base patterns miss.
    (base, full), = pii.all_spans(["please call (212) 555-0187 and ask for tom"], model)
    assert not base and [k for _, k, _ in full] == [3]


def test_windows_do_not_depend_on_neighbours(model):
    text = "word and more " * 9 + "write to someone.else@mail.example.org or " + "call +1 (333) 444-5555 " + "text " * 50
    alone = model.tags(pii.points(text))
    both = model.tags_of([pii.points("1 " * 70), pii.points(text), pii.points("")])
    assert (alone == both[1]).all() and len(both[2]) == 0


def test_every_window_is_decoded(model):
    """Tags equal those of windows decoded one at a time by the layers that training uses, digits in them or not."""
    rng = np.random.default_rng(3)
    texts = [pii.made_up(rng)[0] * int(rng.integers(1, 9)) for _ in range(60)] + ["plain words and nothing else " * 40, "", "x", "a" * pii.WINDOW, "b" * (pii.WINDOW + 1), "c" * (pii.WINDOW + pii.STRIDE + 1)]
    chars = [pii.points(t) for t in texts]
    count = 0
    for c, got in zip(chars, model.tags_of(chars)):
        want = np.zeros(len(c), np.int8)
        near = np.full(len(c), -1)
        last = max(0, -(-(len(c) - pii.WINDOW) // pii.STRIDE)) if len(c) else -1
        for k in range(last + 1):
            a = k * pii.STRIDE
            row = np.full((pii.WINDOW, 1), pii.VOCAB - 1)
            part = c[a : a + pii.WINDOW]
            row[: len(part), 0] = part
            tags = pii.viterbi(np.ascontiguousarray(model.emissions(row)[0].transpose(0, 2, 1)), model.p["trans"])[:, 0]
            count += 1
            for i in range(len(part)):
                far = min(10**6 if a == 0 else i, 10**6 if k == last else pii.WINDOW - 1 - i)
                if far >= near[a + i]:
                    near[a + i], want[a + i] = far, tags[i]
        assert (got == want).all()
    assert count > 150


def test_query(spark, tmp_path):
    texts = [None, "", "no data", "a@b.c é 😀 1.2.3.4 x +1 (434) 555-7062, 4921758104870150", "please call (212) 555-0187 and ask for tom"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    say = lambda xs: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in xs)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = pii.fit(docs)
    for r in pii.op3_personal_data(spark, str(tmp_path)).collect():
        base = plain(texts[r.doc_id] or "")
        full = pii.all_spans([texts[r.doc_id] or ""], model)[0][1]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(say(base).encode()).hexdigest() and r.spans == say(full) and r.n_spans == len(full)
        assert set(base) <= set(full)


def test_find(spark, model):
    texts = [None, "", "no data", "a@b.c é 😀 1.2.3.4 x +1 (434) 555-7062, 4921758104870150", "9" * 5000, "1 " * 3000, "é" * 20000 + " a.b@c.de"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "x@y.zz", 1), (3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int")
    out = pii.find(df, model).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict((i, t) for i, t, _ in rows)[r.doc_id] or ""
        base = [(x.start, pii.KINDS.index(x.kind), x.end) for x in r.base]
        full = [(x.start, pii.KINDS.index(x.kind), x.end) for x in r.full]
        assert base == plain(text) and set(base) <= set(full) and full == sorted(full)
        assert all(not (a < b2 and a2 < b) for a, _, b in set(full) - set(base) for a2, _, b2 in base)
    assert pii.find(df.limit(0), model).count() == 0


def test_reconcile_and_mask():
    assert pii.reconcile([(5, 0, 9), (20, 1, 30)], [(0, 3, 5), (8, 3, 12), (9, 2, 20), (25, 0, 27), (30, 0, 40)]) == [(0, 3, 5), (5, 0, 9), (9, 2, 20), (20, 1, 30), (30, 0, 40)]
    assert pii.mask("ab cd ef", [(0, 0, 2), (3, 1, 7), (6, 2, 8)]) == "<EMAIL> <IP>"


def test_rare_digits_are_trained_on(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 1000 = 7, concat('line ', id), 'no such thing') as text")
    monkeypatch.setattr(pii, "SAMPLE", 3)
    monkeypatch.setattr(pii, "train", sorted)
    assert pii.fit(docs) == ["line 1007", "line 2007", "line 7"]
