"""k-means with bounded sizes against brute force and against the plain method over a matrix."""
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learn, sizes

from . import plain


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(parts, "id")


def cloud(seed, n, dims=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 2, dims) + rng.standard_normal((m, dims)) for m in (n // 2, n // 3, n - n // 2 - n // 3)])


def cost_of(x, labels):
    return sum(((x[labels == j] - x[labels == j].mean(0)) ** 2).sum() for j in np.unique(labels))


def test_settle_is_optimal():
    rng = np.random.default_rng(1)
    for least, most in ((2, 2), (1, 3), (0, 4)):
        for _ in range(10):
            cost = rng.random((6, 3)).round(1)
            flow = np.eye(3, dtype=int)[cost.argmin(1)]
            after = sizes.settle(cost, flow, flow.sum(0), least, most)
            assert (after.sum(1) == 1).all() and (after.sum(0) >= least).all() and (after.sum(0) <= most).all()
            best = min(sum(cost[i, k] for i, k in enumerate(p)) for p in product(range(3), repeat=6) if all(least <= p.count(k) <= most for k in range(3)))
            assert (cost * after).sum() == pytest.approx(best)
    with pytest.raises(ValueError, match="sizes"):
        sizes.settle(cost, flow, flow.sum(0), 3, 4)


def test_groups_move_as_their_points_would():
    rng = np.random.default_rng(2)
    for _ in range(10):
        cost, n = rng.random((12, 4)), rng.integers(1, 30, 12)
        flow = np.eye(4, dtype=int)[cost.argmin(1)] * n[:, None]
        low, high = n.sum() // 4 - 1, -(-n.sum() // 4) + 1
        after = sizes.settle(cost, flow, flow.sum(0), low, high)
        each = np.repeat(cost, n, 0)
        got = plain.balanced_assignment(each, low, high)
        assert (after.sum(1) == n).all() and after.sum(0).min() >= low and after.sum(0).max() <= high
        # The plain method stops once sizes are met, so it can be dearer where bounds leave room.
        assert (cost * after).sum() <= each[np.arange(len(each)), got].sum() + 1e-9


@pytest.mark.parametrize("copies,listed,left", [(0, 1024, 64), (0, 2, 64), (0, 3, 0), (120, 1024, 64), (120, 2, 64)])
def test_settled_is_the_cheapest_for_its_centres(spark, monkeypatch, copies, listed, left):
    monkeypatch.setattr(sizes, "LISTED", listed)
    monkeypatch.setattr(sizes, "LEFT", left)
    x = cloud(3, 240)
    x[:copies] = x[0]
    centres = x[[0, 130, 200, 220]]
    points = frame(spark, x, 5).checkpoint()
    out = sizes.settled(points, sizes.Priced(centres, np.zeros(4), 0.1), 240, 58, 62)
    rows = out.labelled(points).orderBy("id").collect()
    labels = np.array([r.label for r in rows])
    cost = sizes.squares(x, centres)
    assert [r.id for r in rows] == list(range(240)) and [r.pc1 for r in rows] == x[:, 0].tolist()
    assert np.bincount(labels, minlength=4).min() >= 58 and np.bincount(labels, minlength=4).max() <= 62
    assert cost[np.arange(240), labels].sum() == pytest.approx(out.cost)
    # Exact sizes leave the plain method no room, so both costs are optimal; with room, ours is no dearer.
    assert out.cost <= cost[np.arange(240), plain.balanced_assignment(cost, 58, 62)].sum() + 1e-9
    exact = sizes.settled(points, sizes.Priced(centres, np.zeros(4), 0.1), 240, 60, 60)
    assert exact.cost == pytest.approx(cost[np.arange(240), plain.balanced_assignment(cost, 60, 60)].sum())
    assert np.allclose(out.means, [x[labels == j].mean(0) for j in range(4)]) or copies


def test_cost_and_sizes_of_fits(spark):
    x = cloud(5, 600)
    out = {r.id: r.label for r in learn.balanced_kmeans(frame(spark, x), 4, 6).collect()}
    labels = np.array([out[i] for i in range(600)])
    assert np.bincount(labels).min() >= 148 and np.bincount(labels).max() <= 152
    assert list(np.argsort([x[labels == j][:, 0].mean() for j in range(4)])) == [0, 1, 2, 3]
    usual = min(plain.lloyd(x, 4, np.random.default_rng(s), lambda d: plain.balanced_assignment(d, 148, 152))[1] for s in range(6))
    assert cost_of(x, labels) <= 1.01 * usual


def test_copies_one_point_and_few_points(spark):
    same = learn.balanced_kmeans(frame(spark, np.ones((90, 2)), 3), 3, 2, 0)
    assert sorted(r.n for r in same.groupBy("label").agg(F.count("*").alias("n")).collect()) == [30, 30, 30]
    assert learn.balanced_kmeans(frame(spark, np.ones((1, 2))), 3, 2).count() == 1
    assert {r.label for r in learn.balanced_kmeans(frame(spark, cloud(1, 20)), 1, 2).collect()} == {0}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_prices_part_far_clusters(monkeypatch, seed):
    """Between clusters far apart few points tell how to change prices: steps that lower the dual are taken back, and all starts
    end with sizes near the goal, so the bounds that they are compared by mean something."""

    def summed(x, measure):
        out = {}
        for m, v in measure(np.arange(len(x)), x):
            out[m] = out.get(m, 0) + v
        return out

    monkeypatch.setattr(sizes, "totals", summed)
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 6, 4) + rng.standard_normal((int(150 * rng.uniform(0.3, 2)), 4)) for _ in range(9)])
    goal, spread = len(x) / 4, x.var(0).mean()
    models = {m: sizes.Priced(x[rng.choice(len(x), 4, replace=False)], np.zeros(4), sizes.SOFT * spread * 4) for m in range(6)}
    sizes._rest(x, models, goal, 40, 0.05 * goal, 1e-4 * spread)
    for model in models.values():
        sizes.scan(x, {0: model})
        cost, label = model.labels(x)
        assert (np.bincount(label, minlength=4) == model.hard).all() and np.abs(model.hard - goal).max() <= 0.15 * goal
        bound = model.value - goal * model.prices.sum()
        assert model.value == pytest.approx((cost + model.prices).min(1).sum()) and bound <= cost[np.arange(len(x)), label].sum() + np.abs(model.prices).max() * np.abs(model.hard - goal).sum()
