"""The pipeline on a small corpus: each stage against a plain account of it."""

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import packing, pii, quality

from .test_neardup import brute_set


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(15)
    vocab = ["".join(rng.choice(list("abcdefghilmnorstu"), int(n))) for n in rng.integers(2, 9, 600)]
    rows, labels = [], []

    def line(n):
        return " ".join(rng.choice(vocab, n)) + "."

    for i in range(480):
        text = "\n".join(line(int(rng.integers(8, 20))) for _ in range(int(rng.integers(2, 8))))
        toxic = i % 4 == 0
        if toxic:
            words = text.split(" ")
            for _ in range(2):
                words.insert(int(rng.integers(len(words))), ["blargh", "snorkface"][i // 4 % 2])
            text = " ".join(words)
        labels.append((i, 1, int(toxic)))
        rows.append((i, text, "en", "s", len(text)))
    plain = [r for r in rows if r[0] % 4]
    rows += [(1000 + k, plain[k][1] + " one more", "en", "s", 0) for k in range(10)]
    rows += [(2000, "a | b | c | d\n" * 4, "en", "s", 0), (2001, None, "en", "s", None), (2002, line(30) + " mail ann.lee@mail.example.com or 10.1.2.3 please.", None, None, 0)]
    where = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), rows


def test_stages(spark, corpus, tmp_path):
    where, rows = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = [{r.doc_id: r.text for r in out} for out in outs[:4]]
    judged = {r[0]: quality.judge((r[1] or "").encode()) for r in rows}
    assert texts[0] == {i: j[11] for i, j in judged.items() if j[6]} and 2000 not in texts[0] and 2001 not in texts[0]
    assert all(i in texts[0] for i in range(480))
    toxic = {i for i in range(0, 480, 4)}
    assert len(set(texts[1]) & toxic) <= 4 and len((set(texts[0]) - toxic) - set(texts[1])) <= 8
    sets = {i: brute_set(t) for i, t in texts[1].items()}
    gone = set(texts[1]) - set(texts[2])
    for i in texts[1]:
        near = [j for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert (i in gone) == bool(near)
    assert len(gone) > 3 and all(texts[2][i] == texts[1][i] for i in texts[2])
    assert set(texts[3]) == set(texts[2]) and "<EMAIL>" in texts[3][2002] and "<IP>" in texts[3][2002]
    assert not any(pii.base_spans(t) for t in texts[3].values())
    assert sorted((r.doc_id, r.doc_tokens) for r in outs[4] if r.start == 0) == sorted((i, n) for i, n in _tokens(texts[3]).items())


def _tokens(texts):
    words = packing.Words(packing.default_tokenizer())
    return {i: len(ids) // 4 + 1 for i, ids in zip(texts, words.ids([t.encode() for t in texts.values()]))}


def test_run(spark, corpus, tmp_path):
    """``run`` gives the rows that its stages give one after another, each written and read again."""
    out = corpus_pipeline.run(spark, corpus[0])
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus[0]).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert out.columns == docs.columns
    rows = sorted(map(tuple, out.collect()))
    assert len(rows) > 300 and rows == sorted(map(tuple, docs.collect()))


def test_stages_on_awkward_rows(spark, corpus):
    rows = [(None, None, None, None, None, 1, "x"), (5, "", "en", "s", 0, 2, "y"), (5, "", "en", "s", 0, 2, "y"), (6, "word " * 30000, None, "s", None, 3, "z"), (7, "a b", "en", None, 3, 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT2 int, score string")
    given = [docs, docs.limit(0)]
    counts = []
    for df in given:
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, corpus[0])
            got = out.collect()
            if k < 4:
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            counts.append(len(got))
    # No row has ten words but one, which repeats itself; none is toxic; the repeated document stays once a row; all are packed.
    assert counts[0] == 0 and counts[1] == 5 and counts[2] == 5 and counts[3] == 5 and counts[4] >= 5 and counts[5:] == [0] * 5
