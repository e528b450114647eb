"""Operator 11 against tries built from dictionaries of prefixes."""
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, CONV_ID string, depth int"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), role, mark, text))
    out = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        said = [[(role, text) for _, role, _, text in sorted(own[c])] if c in own else [] for c in (conv - conv % 5, conv)]
        out[conv] = tuple(said[0][:h] + said[1][h:])
    return out


def expected(convs):
    members = defaultdict(list)
    for conv, said in convs.items():
        for d in range(len(said) + 1):
            members[said[:d]].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += not children[node]
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if convs[c] == node)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def random_rows(seed, convs, most, kinds, texts="ab"):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        for turn in range(int(rng.integers(0, most + 1))):
            rows.append((c, turn, str(rng.choice(["user", "assistant"][: 1 + kinds % 2])), str(rng.choice(list(texts))) * int(rng.integers(1, 1 + kinds))))
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("seed,convs,most,kinds", [(1, 60, 4, 1), (2, 200, 12, 1), (3, 150, 6, 3), (4, 40, 1, 2), (5, 300, 3, 2)])
def test_random(spark, seed, convs, most, kinds):
    rows = random_rows(seed, convs, most, kinds)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(trie.prefix_trie(df)) == expected(rebuilt(rows))


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "é漢"), (0, 1, "user", "é漢"), (0, 1, None, "b"), (1, 5, "a", ""), (None, 0, "user", "gone"), (7, None, "user", "x" * 100_000), (7, None, "user", "y"), (12, 3, "us", "er"), (13, 3, "u", "ser")]
    rows += [(100 + i, t, "user", f"same {t}") for i in range(12) for t in range(3)]
    rows += [(200 + i, t, "user", f"chain {t}") for i in range(15) for t in range(i)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(trie.prefix_trie(df)) == expected(rebuilt(rows))


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "", 1)], SCHEMA)).count() == 0


def test_only_turnless(spark):
    """Conversations whose turns all lie in the head that an absent one should give are turnless members of the root."""
    ids = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:5]
    rows = [(c, 0, "user", "x") for c in ids if c - c % 5 not in ids]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(trie.prefix_trie(df)) == expected(rebuilt(rows)) and trie.prefix_trie(df).count() == 1


def sorted_blocks(convs, cuts):
    """Blocks over turn digests in the order that the table is sorted by."""
    keyed = sorted((b"".join(hashlib.md5(repr(t).encode()).digest() for t in said), c) for c, said in convs.items())
    return keyed, [keyed[a:b] for a, b in zip([0, *cuts], [*cuts, len(keyed)])]


@pytest.mark.parametrize("seed", range(12))
def test_blocks_of_any_size(spark, seed):
    """The table is dealt to blocks by hand, down to one conversation each: nodes span many of them."""
    rows = random_rows(seed, 50, 6, 1, "a" if seed % 3 == 0 else "ab")
    convs = rebuilt(rows)
    rng = np.random.default_rng(seed)
    keyed, _ = sorted_blocks(convs, [])
    cuts = sorted(rng.choice(np.arange(1, len(keyed)), int(rng.integers(1, len(keyed) - 1)), replace=False).tolist()) if seed % 4 else list(range(1, len(keyed)))
    _, parts = sorted_blocks(convs, cuts)
    shared = [-1, *(trie.common(a[-1][0], b[0][0]) for a, b in zip(parts, parts[1:])), -1]
    inner = [[trie.common(a[0], b[0]) for a, b in zip(p, p[1:])] for p in parts]
    lows = [min([s, *i]) for s, i in zip(shared, inner)]
    spans, out = defaultdict(list), []
    for k, part in enumerate(parts):
        ids = np.array([c for _, c in part])
        said = [convs[c] for c in ids.tolist()]
        block = trie.Block(ids, np.array([len(s) for s in said]), np.array([len(t.encode()) for s in said for _, t in s], np.int64), np.array([shared[k], *inner[k], shared[k + 1]]))
        for r in block.rows(k, lows).to_pylist():
            (out if r["home"] is None else spans[r["home"], r["depth"]]).append(r)
    least = {key: min(r["conv_id"] for r in rs) for key, rs in spans.items()}
    for r in out:
        if r["parent_home"] is not None:
            r["parent_conv_id"] = least[r["parent_home"], r["depth"] - 1]
    for (home, depth), rs in spans.items():
        ends = ",".join(r["ends"] for r in rs if r["ends"] is not None)
        up = {r["parent_home"] for r in rs}
        assert len(up) == 1 and len({r["before"] for r in rs}) == 1
        one = {c: sum(r[c] for r in rs) for c in ("n_convs", "n_children", "n_leaves", "shared")}
        out.append({**one, "conv_id": least[home, depth], "depth": depth, "parent_conv_id": least[up.pop(), depth - 1] if depth else None, "before": rs[0]["before"], "ends": hashlib.sha256(ends.encode()).hexdigest()})
    found = [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["shared"] - (r["n_convs"] - 1) * r["before"], r["ends"]) for r in out]
    assert sorted(map(str, found)) == expected(convs)


def test_nearest_smaller():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.integers(0, 5, 20)
        want = [max([j for j in range(i) if a[j] < a[i]], default=-1) for i in range(20)]
        assert trie.nearest_smaller(a).tolist() == want
        lows = [-1, *rng.integers(0, 4, 10).tolist()]
        assert trie.homes(lows, 11, 6).tolist() == [max(j for j in range(11) if lows[j] < d) for d in range(7)]
