"""Operators 5, 7, 8 and 9 against brute force."""
import hashlib
import re
import zlib
from collections import Counter as Bag

import numpy as np
import pytest

from tidemark.llm import audio, chat, quality, token_counts

TEXTS = [None, "", " ", "a", "one two three four five six seven eight nine ten.", "a b c d e a b c d e a b", "x | y | z | w\nHome | About | Terms | Help",
         "Line one is here.\nLine one is here.\n\n  \nAll rights reserved.", "é ñ 漢字     😀 end.", "w " * 3000, "tab\tsep\x0bmore\x0cfeed\rret\nnew", "%%% $$$ ###", "a" * 5000]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "null id text here.", "x", 2), (3, "a", "again", 3), (3, "a", "again", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, DOC_ID2 int")


def rows_of(spark):
    return [(r.doc_id, r.text) for r in frame(spark).collect()]


def brute_repeat(words):
    grams = Bag(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] >= 2 for j in range(i, i + 5)}
    return len(hit)


def test_quality_counts(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.clean(frame(spark)).collect())
    want = []
    for i, t in rows_of(spark):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = brute_repeat(words)
        want.append((i is None, i or 0, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), rep, len(words) < 10 or 100 * rep > 20 * len(words)))
    assert got == sorted(want)


def test_repeat_words_random():
    rng = np.random.default_rng(0)
    for size in (0, 4, 5, 6, 50, 400):
        for vocab in (1, 2, 3, 10, 9000):
            words = [b"w%d" % k for k in rng.integers(0, vocab, size)]
            assert quality.repeat_words(words) == brute_repeat(words)
    long = [b"w%d" % k for k in range(9000)] * 2
    assert quality.repeat_words(long) == brute_repeat(long)


def test_quality_verdicts():
    prose = b"The quick brown fox went over the hill and came home at night.\n"
    assert quality.judge(prose)[6]
    assert not quality.judge(b"home | about | news | help | terms | more | this | that | here | there")[6]
    mixed = quality.judge(prose * 1 + b"a | b | c | d\nAll rights reserved.\nshort line")
    assert mixed[6] and mixed[11].strip() == prose.decode().strip() and mixed[7:10] == (1, 1, 1)


def test_audio(spark):
    out = {(r.doc_id, r.n_bytes): r for r in audio.media_features(frame(spark)).collect()}
    for i, t in rows_of(spark):
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = out[i, len(raw)]
        rate, back = audio.from_wav(bytes(r.media))
        assert (rate, back) == (8000, want) and r.payload_bytes == len(want) and r.media_bytes == len(r.media)
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        table = audio.read_tensors(bytes(r.tensors))
        assert table.schema.field("tensor").type.shape == [audio.BLOCK, audio.MELS] and table.num_rows == len(r.spans)
        assert [(x.start_ms, x.end_ms) for x in r.spans] == list(zip(table["start_ms"].to_pylist(), table["end_ms"].to_pylist()))
    assert audio.media_features(frame(spark).limit(0)).count() == 0


def test_resample_and_segments():
    x = np.sin(2 * np.pi * 200 * np.arange(8000) / 8000).astype(np.float32)
    y = audio.resample(x)
    assert len(y) == 6000
    peak = np.abs(np.fft.rfft(y)).argmax()
    assert peak == 200
    taps = np.arange(audio.UP * audio.TAPS)
    direct = np.zeros(len(y))
    h = np.sinc((taps - (len(taps) - 1) / 2) / 4) * np.hanning(len(taps) + 2)[1:-1]
    h *= audio.UP / h.sum()
    for m in range(100, 200):  # zero-stuffed convolution at the common rate
        direct[m] = sum(h[k] * x[(m * 4 - k) // 3] for k in range(len(taps)) if (m * 4 - k) % 3 == 0)
    assert np.allclose(direct[100:200], y[100:200], atol=1e-4)
    energy = np.array([0, 0, 9, 5, 5, 0, 0, 9, 9, 0.0])
    state, want = False, []
    for i, e in enumerate([*energy, -99]):
        now = e > energy.mean() + 0.5 * energy.std() or state and not e < energy.mean() - 0.25 * energy.std()
        if now and not state:
            start = i
        if state and not now:
            want.append((start, i))
        state = now
    assert audio.segments(energy) == want


def plain_mel(samples):
    """Log-mel energies by sums as they are defined, in double precision."""
    x = (np.array(list(samples), float) - 128) / 128
    taps = np.arange(audio.UP * audio.TAPS)
    h = np.sinc((taps - (len(taps) - 1) / 2) / max(audio.UP, audio.DOWN)) * np.hanning(len(taps) + 2)[1:-1]
    h *= audio.UP / h.sum()
    y = []
    for n in range(-(-len(x) * audio.UP // audio.DOWN)):  # x with zeros between, filtered, every DOWN-th taken
        y.append(sum(h[k] * x[(n * audio.DOWN - k) // audio.UP] for k in range(len(h)) if (n * audio.DOWN - k) % audio.UP == 0 and 0 <= (n * audio.DOWN - k) // audio.UP < len(x)))
    frames = max(1, -(-(len(y) - audio.FRAME) // audio.HOP) + 1)
    y = np.concatenate([y, np.zeros(frames * audio.HOP + audio.FRAME)])
    rate = audio.RATE * audio.UP / audio.DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(40.0), mel(rate / 2), audio.MELS + 2)]
    bins = np.arange(audio.FRAME // 2 + 1)
    wave = np.exp(-2j * np.pi * np.outer(bins, np.arange(audio.FRAME)) / audio.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1))
    out = np.zeros((frames, audio.MELS))
    for k in range(frames):
        power = np.abs(wave @ (window * y[k * audio.HOP : k * audio.HOP + audio.FRAME])) ** 2
        for m in range(audio.MELS):
            lo, mid, hi = edges[m : m + 3]
            f = bins * rate / audio.FRAME
            weight = np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None)
            out[k, m] = np.log(power @ weight + 1e-6)
    return out


def test_media_query(spark, tmp_path):
    """Stored form, tensors, spans, segments and feature of the query against direct sums."""
    texts = [None, "", "a", "é 漢字 some words of a short text", "one two three four five six. " * 40, "THE END\n" * 130 + "zzzz" * 900]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = audio.op7_media_columns(spark, str(tmp_path))
    assert out.schema["tensors"].metadata["shape"] == [audio.BLOCK, audio.MELS]
    for r in out.collect():
        raw = (texts[r.doc_id] or "").encode()
        want = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        assert audio.from_wav(bytes(r.media)) == (8000, want) and r.n_bytes == len(raw) and r.payload_bytes == len(want)
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
        mel = plain_mel(want)
        table = audio.read_tensors(bytes(r.tensors))
        got = table["tensor"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
        assert len(got) == -(-len(mel) // audio.BLOCK) * audio.BLOCK and np.abs(got[: len(mel)] - mel).max() < 0.02 and not got[len(mel) :].any()
        ms = 1000 * audio.HOP * audio.DOWN / (audio.UP * audio.RATE)
        assert [(x.start_ms, x.end_ms) for x in r.spans] == [(k * ms, min(k + audio.BLOCK, len(mel)) * ms) for k in range(0, len(mel), audio.BLOCK)]
        energy = got[: len(mel)].mean(axis=1)
        mean, dev, on, runs = float(energy.mean()), float(energy.std()), False, []
        for k, e in enumerate([*energy.tolist(), -np.inf]):
            if not on and e > mean + audio.HIGH * dev:
                on, runs = True, [*runs, [k, k]]
            elif on and e < mean + audio.LOW * dev:
                on, runs[-1][1] = False, k
        assert [(x.start_ms, x.end_ms) for x in r.segments] == [(a * ms, (b or len(mel)) * ms) for a, b in runs]
        said = dict(x.split("=") for x in r.feature.split(";"))
        assert (int(said["frames"]), int(said["segments"]), int(said["voiced"])) == (len(mel), len(runs), sum(b - a for a, b in runs))
        assert np.abs(np.array(said["mel"].split(","), float) - mel.mean(axis=0)).max() < 0.02


def test_escape_round_trip():
    rng = np.random.default_rng(1)
    bits = [*chat.CONTROLS, b"\\", b"<", b"[", b"/INST]", b"|turn|>", b"x", "é".encode(), b"\n", b"s>"]
    for _ in range(2000):
        t = b"".join(bits[k] for k in rng.integers(0, len(bits), rng.integers(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", said), (1, 0, "user", "hi \\ <|end|>\n there"), (2, 0, None, None), (2, 1, "assistant", "é<|text|>"), (None, 0, "assistant", "x"), (2, 1, "assistant", "é<|text|>")]
    rows += [(7, k, "assistant" if k % 2 else "user", f"turn {k} é") for k in range(3000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        all_ = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(all_.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_token_counts_match_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocab = token_counts.load_vocab(token_counts.default_model())
    full = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *vocab]
    own = tokenizers.Tokenizer(tokenizers.models.Unigram(full, unk_id=0, byte_fallback=True))
    own.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend("▁"), tokenizers.normalizers.Replace(" ", "▁")])
    texts = [t for t in TEXTS if t] + ["  two  spaces \n\n new\nline ", "\n", " x", "naïve Ωμέγα 語 \U0001f600\U0001f601x", "The theanedble attion."]
    counter = token_counts.Counter(vocab)
    rng = np.random.default_rng(2)
    texts += ["".join(rng.choice(list("aeth n\n▁é😀s"), 40)) for _ in range(200)]
    for t in texts:
        assert counter.count(t) == len(own.encode(t, add_special_tokens=False).ids), t
    out = token_counts.token_counts(frame(spark)).collect()
    assert sorted(r.n_tokens for r in out) == sorted(counter.count(t or "") for _, t in rows_of(spark))


def test_ties_take_the_earliest_start():
    # "ab" + "c" and "a" + "bc" score alike: the piece that starts first wins at each end.
    counter = token_counts.Counter([("▁", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("abc", -3.0)])
    assert counter.viterbi("abc") == 1 and counter.viterbi("ab") == 1
