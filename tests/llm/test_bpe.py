"""Operator 2 against the tiktoken library."""
import hashlib

import numpy as np
import pytest

from tidemark.llm import bpe


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.default_ranks(), special_tokens={})


def test_encode_and_decode(spark, library, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "  ", "a", " lead", "trail ", "it's I'll\n\nnew  line \n x", "é 漢字 😀 <|endoftext|>", "nb sp x y", "x" * 3000, "word " * 4000, "tab\t\tx\r\n1234 56"]
    texts += ["".join(rng.choice(list("ab's 1\n\t.é "), rng.integers(0, 60))) for _ in range(150)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "null id", "c"), (4, "a", "c"), (4, "a", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3).cache()
    df.count()
    want = sorted((i is None, i or 0, library.encode_ordinary(t or "")) for i, t, _ in rows)
    encoded = bpe.encode(df).cache()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in encoded.collect()) == want
    back = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.text)) for r in bpe.decode(encoded).collect())
    assert back == sorted((i is None, i or 0, (t or "").encode()) for i, t, _ in rows)
    got = {r.doc_id: r for r in bpe.encode(df, digests=True).collect()}
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0)).count() == 0


def test_many_blocks_and_alike_blocks(library):
    import regex

    split = regex.compile(bpe.default_pattern())
    names = set()
    for _ in range(2):
        block = bpe.Block(split)
        block.add(1, "the same text here")
        block.add(None, "")
        name, dealt, data = block.seal(4)
        names.add(name)
        answers = {}
        for part, words in dealt:
            ids = [library.encode_ordinary(w.decode()) for w in words]
            answers[part] = [np.array([len(x) for x in ids]), np.array([k for x in ids for k in x], np.uint32)]
        out = [(d, x.tolist()) for d, x in bpe.open_block(data, answers)]
        assert out == [(1, library.encode_ordinary("the same text here")), (None, [])]
    assert len(names) == 1


def test_numbers_by_upper_bytes():
    rng = np.random.default_rng(4)
    for n in (np.zeros(0, np.int64), np.array([0]), rng.integers(0, 2**32, 999), rng.integers(0, 700, 5000)):
        high, low = (np.frombuffer(x, np.uint8) for x in bpe.by_high(n))
        assert (bpe.from_high(high, low) == n).all()


def test_input_that_comes_in_another_order_each_time(spark, library):
    """The input is split once: a frame whose rows lie elsewhere each time it is read has the same ids."""
    from pyspark.sql import functions as F

    texts = ["".join(f"w{i % 17} it's {i * k} " for k in range(9)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).orderBy(F.rand()).repartition(7, F.rand())
    got = sorted((r.doc_id, r.ids) for r in bpe.encode(df).collect())
    assert [i for i, _ in got] == list(range(300)) and all(ids == library.encode_ordinary(texts[i]) for i, ids in got)


def test_query(spark, library, tmp_path):
    texts = [None, "", "a few words, and a few words more", "é 漢字\n\n 12 it's"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in bpe.op2_byte_bpe(spark, str(tmp_path)).collect():
        ids, text = library.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_blocks_of_one_shape_and_other_words(spark, library):
    texts = ["foo", "bar", "baz", "qux", "the", "cat"]
    rows = spark.sparkContext.parallelize([(None, t) for t in texts], len(texts))  # a partition, and so a block, each
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.ids for r in bpe.encode(df).collect())
    assert got == sorted(library.encode_ordinary(t) for t in texts)
