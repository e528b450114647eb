"""Operator 13 against both libraries over whole texts, byte by byte."""
import hashlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import alignment


@pytest.fixture(scope="module")
def aligner():
    pytest.importorskip("tokenizers")
    pytest.importorskip("sentencepiece")
    return alignment.Aligner(*alignment.default_tokenizers())


def plain(aligner, text):
    """Ids of A and B, groups and links of one text, from sets of byte offsets."""
    whole = f" {text or ''}".encode()
    a = aligner.a.encode(f" {text or ''}", add_special_tokens=False).ids
    b = aligner.b.encode(text or "")
    if not text or b"".join(aligner.a_bytes[i] for i in a) != whole or b"".join(aligner.b_bytes[i] for i in b) != whole:
        return [], [], [], []
    spans = []
    for ids, table in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends)))
    links = [(x, y) for x, (p, q) in zip(a, spans[0]) for y, (r, s) in zip(b, spans[1]) if max(p, r) < min(q, s)]
    cuts = sorted({q for _, q in spans[0]} & {s for _, s in spans[1]})
    groups = []
    for low, high in zip([0, *cuts], cuts):
        groups.append(tuple([i for i, (p, q) in zip(ids, at) if low <= p and q <= high] for ids, at in zip((a, b), spans)))
    return a, b, groups, links


def expected(aligner, rows):
    found = [(doc, *plain(aligner, text)) for doc, text in rows]
    counts = Counter(link for *_, links in found for link in links)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for doc, a, b, groups, links in found:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.select(*(x.split()[0] for x in alignment.SCHEMA.split(", "))).collect())


def awkward():
    rng = np.random.default_rng(7)
    texts = [None, "", " ", "  ", "a", " lead", "trail ", "trail\n", "\n", "\n\n", "it's I'll\n\nnew  line \n x", "é 漢字 😀 <|endoftext|> <s> </s>", "nb sp x y", "▁ mark", "a▁b", "x" * 900]
    texts += ["word, " * 400, "tab\t\tx\r\n1234 56", "a\x1c b \x1c!", "! \x0b\n  b", "é ́ x", "　a 　\n b", "\x00 a", "<0x0A> b", "the the", "the the"]
    signs = list("ab's 1\n\t.é ,!▁") + [" ", "  ", "\n ", " the", "ing", "　", "\x1f", "漢", "́"]
    texts += ["".join(rng.choice(signs[:-4] if i % 3 else signs, rng.integers(0, 40))) for i in range(400)]
    return texts


def test_whole_texts_by_libraries(spark, aligner):
    rows = [*enumerate(awkward()), (None, "null id"), (4, "a"), (4, "a"), (4, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, DOC_ID string, block int").repartition(3)
    assert got(alignment.align(df)) == expected(aligner, rows)


def test_many_small_blocks(spark, aligner):
    rows = list(enumerate(awkward()[:120])) * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(alignment.align(df, block_bytes=60)) == expected(aligner, rows)


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert got(alignment.align(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"))) == sorted(["(1, 0, 0, 0, 0, 0, 0, '')", "(None, 0, 0, 0, 0, 0, 0, '')"])


def test_chunks_hold_the_text(aligner):
    for text in awkward():
        if text:
            assert "".join(aligner.chunks(text)) == f" {text}"
            if alignment.MARK not in text:  # such a text has no tokens
                assert aligner.b.encode(text) == [i for ids in aligner._b_ids(aligner.chunks(text)) for i in ids]
            ids, sizes = aligner._a_ids(aligner.chunks(text))
            assert aligner.a.encode(f" {text}").ids == ids.tolist() and sizes.sum() == len(ids)


def test_query(spark, aligner, tmp_path):
    from tidemark.llm.catalog import QUERIES

    rows = [(1, "Plain words, and more of them."), (2, "Plain words, and more of them."), (3, None), (4, "Ünïcode\ntoo " * 30)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(QUERIES["op13_alignment"](spark, str(tmp_path))) == expected(aligner, rows)
