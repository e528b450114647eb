"""Operator 12: features against plain loops, the fit against its optimality conditions, the query against loops and held-out labels."""
import os
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import quality_model as M
from tidemark.llm._common import lowest

DATA = "/root/testdata/sf0.01"


def plain_buckets(text):
    """Buckets of one text by loops; hashes of words and keys as the module makes them."""
    words = re.findall(rb"[^ \t\n\x0b\x0c\r\0]+", text)
    spans = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r\0]+", text)]
    low = [w.lower() for w in words]
    hashes = [int(M.word_places(np.frombuffer(w, np.uint8), M._SOLID)[2][0]) for w in low]
    out, symbols = set(), bytearray()
    kinds = bytearray()
    for b in text.replace(b"\0", b" "):
        c = chr(b)
        kinds.append(ord("a") if "a" <= c <= "z" or b >= 128 else ord("A") if "A" <= c <= "Z" else ord("0") if "0" <= c <= "9" else b)
    for i in range(1, len(words)):
        if low[i] == low[i - 1]:
            a, b = spans[i]
            kinds[a:b] = bytes([M.REPEAT]) * (b - a)
    for b in kinds:
        if not symbols or symbols[-1] != b:
            symbols.append(b)
    one = lambda key, salt: int(M._bucket(np.array([key % 2**64], np.uint64), salt)[0])
    out |= {one(h, 1) for h in hashes}
    out |= {one(b * 0x9E3779B97F4A7C15 + a, 2) for a, b in zip(hashes, hashes[1:])}
    for n in range(1, M.GRAMS + 1):
        out |= {one(int.from_bytes(symbols[i : i + n], "big"), 2 + n) for i in range(len(symbols) - n + 1)}
    return sorted(out)


def test_features():
    rng = np.random.default_rng(1)
    texts = [b"", b" ", b"a", b"The the THE dog", "Ünï ünï é\n\n!!".encode(), b"\0a\0\0b", b"x " * 50, b"$$$ 12,300% of #*"]
    texts += [bytes(rng.choice(list(b"aAbB 1!\n"), int(rng.integers(0, 40))).astype(np.uint8)) for _ in range(80)]
    assert [f.tolist() for f in M.features(texts)] == [plain_buckets(t) for t in texts]
    assert [f.tolist() for t in texts for f in M.features([t])] == [plain_buckets(t) for t in texts]


def test_descent_is_optimal():
    """Primal and dual objectives meet, and every support vector lies at its side of the margin."""
    rng = np.random.default_rng(2)
    labels = (rng.random(120) < 0.7).astype(np.int64)
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 8), rng.integers(40, 60, 2) + 20 * y])) for y in labels]
    ratios = M.log_ratios(rows, labels)
    weights, bias = M.descend(rows, labels, ratios)
    margins = np.array([weights[r] @ ratios[r] / np.sqrt((ratios[r] ** 2).sum()) + bias for r in rows])
    signs = np.where(labels == 1, 1, -1)
    cost = M.COST * len(rows) / 2 / np.bincount(labels)[labels]
    primal = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - signs * np.array([w[r] @ ratios[r] / np.sqrt((ratios[r] ** 2).sum()) + b for r in rows]))).sum()
    best = primal(weights, bias)
    for _ in range(60):
        w = weights.copy()
        w[:80] += rng.normal(0, 0.05, 80)
        assert primal(w, bias + rng.normal(0, 0.05)) >= best * (1 - 1e-3)
    assert (np.sign(margins) == signs).mean() > 0.95


def test_one_label_and_none():
    assert M.train([], np.array([])).scores([b"x", b""]).tolist() == pytest.approx([1, 1])
    assert (M.train([b"x"], np.array([0])).scores([b"x", b""]) < 0.01).all()
    assert (M.train([b"x", b"y"], np.array([1, 1])).scores([b"x", b""]) > 0.99).all()
    two = M.train([b"good plain words", b"## $$ %%"], np.array([1, 0])).scores([b"good plain words", b"## $$ %%"])
    assert two[0] > two[1]


def test_query_on_odd_rows(spark, tmp_path):
    docs = [(i, f"plain words number {i} and more of these here" if i % 3 else "BUY!! NOW!! ### $$$ " * (1 + i % 4)) for i in range(120)]
    docs += [(None, "no id"), (500, None), (501, ""), (502, "word " * 60_000), (7, docs[7][1]), (7, "another text")]
    labels = [(i, int(i % 3 > 0)) for i in range(120)] + [(3, 0), (None, 1), (900, 1), (5, None)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    from tidemark.llm.catalog import QUERIES

    got = QUERIES["op12_quality_classifier"](spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = M.fit(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = [(i, None if i is None else zlib.crc32(str(i).encode()) % 4 == 2, round(float(model.scores([(t or "").encode()])[0]), 9)) for i, t in docs]
    assert sorted(map(str, ((r.doc_id, r.held_out, round(r.score, 9)) for r in got))) == sorted(map(str, want))
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    right = [r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 120 and r.held_out and r.doc_id != 7]
    assert len(right) > 10 and np.mean(right) > 0.95
    clash = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, DOC_ID int")
    assert M.score(clash, model).count() == 1 and M.score(clash.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    from tidemark.llm.catalog import QUERIES

    got = QUERIES["op12_quality_classifier"](spark, DATA).filter("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r.quality], [r for r in got if not r.quality]
    assert np.mean([r.predicted for r in good]) > 0.98 and np.mean([1 - r.predicted for r in bad]) > 0.9


def test_sample_of_repeated_keys(spark):
    """Rows whose keys are null or repeated are sampled in full, and as plain sorting takes them."""
    from pyspark.sql import functions as F

    frames = {
        "null": spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 50_000).alias("text")),
        "one": spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("same").alias("text")),
        "own": spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")),
        "few": spark.range(50).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")),
    }
    for name, df in frames.items():
        order = lambda d: [tuple(r) for r in d.orderBy("h", "doc_id", "text").limit(300).collect()]
        some = lowest(df, ["doc_id", "text"], 300)
        assert order(some) == order(df.withColumn("h", F.xxhash64("doc_id", "text")))
        assert len(order(some)) == min(300, df.count())
        if name == "own":
            assert some.count() < 3000
