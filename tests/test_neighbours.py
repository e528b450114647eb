"""Neighbour search, DBSCAN and HDBSCAN in blocks of any size against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, density, hierarchy, near


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, x array<double>")


def scattered(seed, dims=3):
    """Blobs, a line of noise, and equal points."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (int(m), dims)) for c, s, m in zip(rng.normal(0, 4, (4, dims)), rng.uniform(0.2, 1, 4), rng.integers(6, 16, 4))]
    return np.concatenate([*parts, rng.uniform(-8, 8, (6, dims)), np.repeat(rng.normal(0, 4, (1, dims)), 4, 0)])


def brute_density_tree(x, least):
    """Clusters by excess of mass, from components of the mutual reachability graph at every level, as they are defined."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, min(least, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    levels = sorted(set(reach[np.triu_indices(n, 1)].tolist()), reverse=True)

    def parts(points, under):
        left, out = set(points), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                i = todo.pop()
                seen.add(i)
                new = {j for j in left if reach[i, j] < under}
                left -= new
                todo += new
            out.append(frozenset(seen))
        return out

    def grow(points, birth):
        """(stability, clusters below) of the cluster born at 1 / birth with these points."""
        now, total = points, 0.0
        for w in levels:
            split = parts(now, w)
            if len(split) == 1:
                continue
            big = [p for p in split if len(p) >= least]
            if len(big) == 1:
                total += (1 / w - birth) * (len(now) - len(big[0]))
                now = big[0]
                continue
            total += (1 / w - birth) * len(now)
            return points, total, [grow(p, 1 / w) for p in big]
        return points, total, []

    def choose(node, root):
        points, own, below = node
        found = [choose(b, False) for b in below]
        under = sum(f[0] for f in found)
        if root or (below and under > own):
            return under, [p for f in found for p in f[1]]
        return own, [points]

    return {frozenset(p) for p in choose(grow(frozenset(range(n)), 0.0), True)[1]}


def pairwise(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


@pytest.mark.parametrize("block", [7, 1000])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(near.Placed.__init__, "__defaults__", (block,))
    x = scattered(3)
    ids = np.random.default_rng(1).permutation(len(x)) * 3 - 50
    d = pairwise(x)
    want = []
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (d[i, j], ids[j]))[:6]
        want += [(int(ids[i]), r + 1, int(ids[j]), round(d[i, j], 9)) for r, j in enumerate(order)]
    got = [(r.id, r.rn, r.other, round(r.d, 9)) for r in density.nearest(frame(spark, x, ids), 6).collect()]
    assert sorted(got) == sorted(want)
    assert density.nearest(frame(spark, x[:3]), 6).count() == 9


@pytest.mark.parametrize("seed,block", [(1, 6), (2, 9), (3, 1000)])
def test_dbscan(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near.Placed.__init__, "__defaults__", (block,))
    x, eps, least = scattered(seed), 0.9, 4
    close = pairwise(x) <= eps
    core = close.sum(1) >= least
    root = np.where(core, np.arange(len(x)), len(x))
    for _ in range(len(x)):
        root = np.where(core, np.where(close & core, root, len(x)).min(1, initial=len(x)), len(x))
    final = np.where(core, root, np.where(close, root, len(x)).min(1))
    names = {r: k for k, r in enumerate(sorted(set(final.tolist()) - {len(x)}))}
    got = {r.id: r.label for r in density.dbscan(frame(spark, x), eps, least).collect()}
    assert got == {i: names.get(int(r), -1) for i, r in enumerate(final)}


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.label, set()).add(r.id)
    out.pop(-1, None)
    assert [min(out[k]) for k in sorted(out)] == sorted(min(v) for v in out.values()) and sorted(out) == list(range(len(out)))
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("seed,block,slab", [(0, 1000, 1000), (1, 14, 1000), (2, 1000, 18), (3, 12, 30)])
def test_density_tree_against_brute_force(spark, seed, block, slab):
    x = scattered(seed, 2)[:-4]
    assert clusters(hierarchy.hdbscan(frame(spark, x), 5, block, slab)) == brute_density_tree(x, 5)


def test_spanning_tree_weighs_least(spark):
    x = scattered(6)
    d = pairwise(x)
    core = np.sort(d, 1)[:, 4]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    near_, todo, total = reach[0].copy(), set(range(1, len(x))), []
    while todo:
        at = min(todo, key=lambda i: near_[i])
        total.append(near_[at])
        todo.remove(at)
        near_ = np.minimum(near_, reach[at])
    for block in (9, 1000):
        rows = hierarchy.spanning_tree(frame(spark, x), 5, block).collect()
        assert len(rows) == len(x) - 1 and np.allclose(sorted(r.w for r in rows), sorted(total))
        assert all(abs(reach[r.a, r.b] - r.w) < 1e-12 for r in rows)


def test_small_and_equal_points(spark):
    one = frame(spark, np.zeros((1, 2)))
    assert [r.label for r in hierarchy.hdbscan(one, 5).collect()] == [-1]
    assert {r.label for r in hierarchy.hdbscan(frame(spark, np.zeros((9, 2))), 3).collect()} == {-1}
    two = frame(spark, np.repeat([[0.0, 0.0], [9.0, 9.0]], 6, 0))
    assert sorted(r.label for r in hierarchy.hdbscan(two, 4, 3, 2).collect()) == [0] * 6 + [1] * 6
    for fit in (hierarchy.hdbscan, density.nearest, density.knn_distances):
        with pytest.raises(ValueError, match="no points"):
            fit(one.limit(0), 3)
    with pytest.raises(ValueError, match="no points"):
        density.dbscan(one.limit(0), 1.0)


def test_bounds_hold_and_prune(spark):
    x = np.concatenate([np.random.default_rng(k).normal(k * 5, 0.4, (80, 4)) for k in range(5)])
    placed = near.Placed(frame(spark, x), 20)
    cells = {}
    for r in placed.rows.collect():
        cells.setdefault(r.cell, []).append(x[r.id])
    for a in cells:
        for b in cells:
            if a != b:
                least = np.sqrt(((np.array(cells[a])[:, None] - np.array(cells[b])[None]) ** 2).sum(2)).min()
                assert placed.bounds.lower[a, b] <= least
        away = placed.bounds.beyond(np.array(cells[a]), a, True)
        for v, low in zip(cells[a], away):
            assert all(low <= np.sqrt(((np.array(cells[b]) - v) ** 2).sum(1)).min() for b in cells if b != a)
    met = placed.pairs(1.0).count()
    assert placed.count <= met < 0.5 * placed.count**2


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(20)]
    root = {i: i for ab in links for i in ab}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    frame_ = spark.createDataFrame(links, "a long, b long")
    for last in (0, 12, 1000):
        assert {r.id: r.root for r in blocks.components(frame_, last).collect()} == root


@pytest.mark.parametrize("dims", [1, 5, 7, 8, 20])
def test_distances_are_sums_of_squares_in_order(monkeypatch, dims):
    monkeypatch.setattr(blocks, "NEAR_BYTES", 999)
    a, b = np.random.default_rng(dims).standard_normal((2, 37, dims))
    for own, other in ((a, b), (a[:0], b), (a, b[:0])):
        assert np.array_equal(blocks.distances(own, other), np.sqrt(((own[:, None] - other[None]) ** 2).sum(2)))


def test_nearest_of_many_copies_have_the_smallest_ids():
    rng = np.random.default_rng(5)
    own = {"id": np.arange(20), "x": np.repeat(rng.integers(0, 2, (20, 1)), 2, 1).astype(float)}
    every = {"id": rng.permutation(300), "x": rng.integers(0, 2, (300, 2)).astype(float)}
    seen = density._Nearest(own, 6)
    for at in (0, 3, 150, 151):
        seen.see({c: v[at : {0: 3, 3: 150, 150: 151, 151: 300}[at]] for c, v in every.items()})
    d = blocks.distances(own["x"], every["x"])
    want = [sorted(zip(row, every["id"]))[:6] for row in d]
    assert [list(zip(*r)) for r in zip(seen.d, seen.other)] == want


def test_points_above_their_components_bound_are_passed_over(spark, monkeypatch):
    """A point's edges weigh its core distance at least, so only points up to the bound meet others."""
    met = []
    reach = hierarchy._reach
    monkeypatch.setattr(hierarchy, "_reach", lambda a, b: met.append((len(a["id"]), len(b["id"]))) or reach(a, b))
    rows = {"id": np.arange(4), "x": np.arange(4.0)[:, None], "core": np.array([1.0, 1, 3, 1]), "comp": np.array([0, 0, 0, 3]), "up": np.ones(4), "own": np.zeros(4, int)}
    lightest = hierarchy._Lightest(rows)
    lightest.see({"id": np.array([4, 5]), "x": np.array([[4.0], [5]]), "core": np.array([1.0, 9]), "comp": np.array([4, 5])})
    assert met == [(3, 1)]
    found = lightest.done().to_pylist()
    assert [(r["comp"], r["w"], r["a"], r["b"], r["other"]) for r in found] == [(0, 3.0, 1, 4, 4), (3, 1.0, 3, 4, 4)]


def _points(spark, x, **more):
    names = ["id", "x", *more]
    kinds = {"id": "long", "x": "array<double>", "label": "int"}
    return spark.createDataFrame([(i, v.tolist(), *(int(c[i]) for c in more.values())) for i, v in enumerate(x)], ", ".join(f"{n} {kinds[n]}" for n in names))


def test_visitors_of_one_block_are_joined(spark, monkeypatch):
    """Where tasks keep few others at hand, a block is visited in turns; results are those of all pairs, copies included."""
    from tidemark.operators import metrics, near

    monkeypatch.setattr(near, "HELD", 4000)
    monkeypatch.setattr(near, "TASKS", 2)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((70, 9)), np.repeat(rng.standard_normal((2, 9)), 15, 0)]) + 100
    label = rng.integers(0, 3, len(x))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    placed = near.Placed(_points(spark, x), 16)
    got = density.nearest_of(placed, 4).orderBy("id", "rn").collect()
    want = [sorted(zip(row, range(len(x))))[:4] for row in d]
    assert [[(r.d, r.other) for r in got if r.id == i] for i in range(len(x))] == want
    found = {r.id: r.s for r in metrics.silhouettes(_points(spark, x, label=label)).collect()}
    for i in range(len(x)):
        means = [d[i, label == c].sum() / max(1, (label == c).sum() - (c == label[i])) for c in range(3)]
        a, b = means[label[i]], min(m for c, m in enumerate(means) if c != label[i])
        assert found[i] == pytest.approx((b - a) / max(a, b), abs=1e-8)


def test_pairs_in_doubt_are_told_by_differences():
    """Products of matrices lose digits of near points far from the origin; what they leave in doubt is measured again."""
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((60, 12)), rng.standard_normal((50, 12))
    a[:20], b[:20] = a[20:40] + 1e-9 * rng.standard_normal((20, 12)), a[20:40]
    a, b = a + 1e3, b + 1e3
    d = blocks.distances(a, b)
    assert np.allclose(blocks.quick(a, b), d, rtol=1e-8, atol=0)
    for eps in (d[25, 5], d[3, 7], d[40, 30], np.nextafter(d[40, 30], 0), 0.0):
        assert (blocks.within(a, b, eps) == (d <= eps)).all()


def test_methods_meet_once(spark, monkeypatch):
    from tidemark.operators import metrics, sweeps

    met, visit = [], sweeps.visit
    monkeypatch.setattr(sweeps, "visit", lambda *a: met.append(1) or visit(*a))
    x = np.random.default_rng(6).standard_normal((50, 9))
    labels = spark.createDataFrame([(i, m, (i * j + i // 7) % 3 - (m == "c" and i % 5 == 0)) for i in range(50) for j, m in enumerate("bac", 1)], "id long, method string, label int")
    rows = metrics.compare_methods(_points(spark, x), labels).collect()
    assert len(met) == 1 and [r.method for r in rows] == ["a", "b", "c"]
    for r in rows:
        own = _points(spark, x).join(labels.filter((F.col("method") == r.method) & (F.col("label") >= 0)), "id")
        assert r.silhouette == pytest.approx(metrics.silhouettes(own).agg(F.avg("s")).first()[0])
        assert r.davies_bouldin == pytest.approx(metrics.davies_bouldin(own).first()[0])
        assert r.calinski_harabasz == pytest.approx(metrics.calinski_harabasz(own).first()[0])


def test_affinity_finds_the_nearest_once(spark):
    """The graph and its transpose come from one table of nearest points."""
    x = np.random.default_rng(7).standard_normal((40, 3))
    edges = density.affinity(_points(spark, x), 4)
    assert "Cartesian" not in edges._jdf.queryExecution().toString()
    order = [sorted(range(40), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:4] for i in range(40)]
    want = {}
    for i, own in enumerate(order):
        for j in own:
            want[i, j] = want.get((i, j), 0) + 0.5
            want[j, i] = want.get((j, i), 0) + 0.5
    assert {(r.id, r.other): r.w for r in edges.collect()} == want
