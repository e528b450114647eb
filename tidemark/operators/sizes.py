"""k-means whose clusters have sizes within bounds, over any number of points.

A point goes to the cluster with the least squared distance plus price. Prices are multipliers of the size bounds: Newton steps
on the softened dual find them, from sums over all points that one scan gives for all starts. What prices cannot part exactly
(the last few points, and copies) is settled by moves along cheapest paths between clusters: of each two clusters the cheapest
movers are listed by Spark, equal points as one row with their number, so the driver sees some lists of bounded length. Where
the moves would need a point beyond the end of a list, longer lists are made.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near import batch_of, columns
from .sweeps import CHUNK, STEP, Starts, split, squares, totals

#: Movers listed of each two clusters at first, and points that prices may leave to moves.
LISTED, LEFT = 1024, 64
#: Scans at most for the prices of one set of centres.
PRICED = 96
#: The dual's softness at first, as a share of the points' variance.
SOFT = 0.02


@dataclass
class Priced:
    """Centres and prices of one model, and what a scan says of them."""

    centres: np.ndarray
    prices: np.ndarray
    soft: float
    sums: np.ndarray | None = None
    hard: np.ndarray | None = None
    shares: np.ndarray | None = None
    products: np.ndarray | None = None
    value: float = np.inf
    soft_value: float = np.inf
    radius: float = 0.0
    kept: tuple | None = None

    def labels(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centres, and the cluster of each point."""
        d = squares(x, self.centres)
        return d, (d + self.prices).argmin(1)

    def read(self, v: np.ndarray) -> None:
        k, d = self.centres.shape
        self.sums, self.hard, self.shares, self.products, last = np.split(v, np.cumsum([k * d, k, k, k * k]))
        self.sums, self.products, (self.value, self.soft_value) = self.sums.reshape(k, d), self.products.reshape(k, k), last.tolist()

    def judged(self, goal: float) -> bool:
        """Whether the prices are no worse by the softened dual than those before them, which come back otherwise, with shorter steps."""
        dual = self.soft_value - goal * float(self.prices.sum())
        if self.kept is None or dual >= self.kept[0] - 1e-12 * abs(self.kept[0]):
            if self.kept is not None:
                self.radius = max(self.radius, 2 * float(np.abs(self.prices - self.kept[1]).max()))
            self.kept = (dual, self.prices, self.shares, self.products)
            return True
        self.radius = min(self.radius, float(np.abs(self.prices - self.kept[1]).max())) / 4
        _, self.prices, self.shares, self.products = self.kept
        return False

    def changed(self, centres: np.ndarray | None = None, soft: float | None = None) -> None:
        """Other centres or another softness, by which no dual is known yet."""
        self.centres = self.centres if centres is None else centres
        self.soft = soft or self.soft
        self.kept, self.radius = None, max(self.radius, 5 * self.soft)

    def off(self, goal: float) -> float:
        """By how much soft sizes miss the goal."""
        return float(np.abs(self.shares - goal).max())

    def fits(self, goal: float) -> bool:
        """Whether soft sizes miss the goal by few of the points between clusters, so that sharper prices can be found from these."""
        return self.off(goal) <= max(1.0, float((self.shares - np.diag(self.products)).sum()) / 8)

    def step(self, goal: float) -> None:
        """Prices by one Newton step towards equal soft sizes, shortened to what is trusted."""
        self.radius = self.radius or 5 * self.soft
        bend = (np.diag(self.shares) - self.products) / self.soft
        bend += np.eye(len(bend)) * 1e-9 * (goal + 1) / self.soft
        move = np.linalg.solve(bend, self.shares - goal)
        move -= move.mean()
        self.prices = self.prices + move * min(1.0, self.radius / max(1e-300, float(np.abs(move).max())))

    def means(self) -> np.ndarray:
        return np.where(self.hard[:, None] > 0, self.sums / np.maximum(self.hard, 1)[:, None], self.centres)


def scan(points: DataFrame, models: dict[int, Priced]) -> None:
    """One scan of the points for all models: sums and sizes by cluster, soft sizes and their products, sums of priced
    distances and of softened ones.

    Distances are summed as ``squares`` does, so sizes are those of ``Priced.labels``.
    """
    k = len(next(iter(models.values())).centres)
    groups = [(part, *(np.stack([getattr(models[m], c) for m in part], -1) for c in ("centres", "prices", "soft"))) for part in split(list(models), k)]

    def measure(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(x), CHUNK):
            rows = x[at : at + CHUNK]
            for part, centres, prices, soft in groups:
                d = np.zeros((k, len(part), len(rows)))
                for j in range(x.shape[1]):
                    one = rows[:, j] - centres[:, j, :, None]
                    one *= one
                    d += one
                d += prices[:, :, None]
                least = d.min(0)
                own = (d == least).astype(float)
                if own.sum() != least.size:
                    own = (np.arange(k)[:, None, None] == d.argmin(0)).astype(float)
                share = np.exp((least - d) / soft[:, None])
                whole = share.sum(0)
                share /= whole
                softest = (least - soft[:, None] * np.log(whole)).sum(1)
                each = share.transpose(1, 0, 2)
                for i, (m, products) in enumerate(zip(part, each @ each.transpose(0, 2, 1))):
                    yield m, np.concatenate([(own[:, i] @ rows).ravel(), own[:, i].sum(1), share[:, i].sum(1), products.ravel(), [least[i].sum(), softest[i]]])

    for m, v in totals(points, measure).items():
        models[m].read(v)


def settle(cost: np.ndarray, flow: np.ndarray, sizes: np.ndarray, least: int, most: int, beyond: np.ndarray | None = None) -> np.ndarray | None:
    """The cheapest ``flow`` (groups of equal points by cluster) with every size in [least, most].

    ``cost`` has a row a group; ``flow`` and ``sizes`` must be the cheapest for their own sizes, and ``sizes`` may hold points
    that are in no group. Groups move along cheapest paths between clusters, as many points at a time as the path carries.
    ``beyond``: what a move between two clusters costs at least for points that are in no group; None is returned where such a
    point could be on a cheapest path.
    """
    k = cost.shape[1]
    if not least * k <= sizes.sum() <= most * k:
        raise ValueError("sizes cannot be met")
    flow, sizes = flow.copy(), sizes.copy()
    tiny = 1e-12 * max(1e-300, float(np.abs(cost).max(initial=0)))
    while True:
        step, mover = np.full((k, k), np.inf) if beyond is None else beyond.copy(), np.full((k, k), -1)
        for a in range(k):
            own = np.flatnonzero(flow[:, a] > 0)
            if len(own):
                extra = cost[own] - cost[own, a][:, None]
                known = extra.min(0) <= step[a]
                step[a, known], mover[a, known] = extra.min(0)[known], own[extra.argmin(0)][known]
        np.fill_diagonal(step, np.inf)
        if (sizes > most).any():
            sources, sinks, must = sizes > most, sizes < most, True
        elif (sizes < least).any():
            sources, sinks, must = sizes > least, sizes < least, True
        else:
            sources, sinks, must = sizes > least, sizes < most, False
        dist, prev = np.where(sources, 0.0, np.inf), np.full(k, -1)
        for _ in range(k):
            through = dist[:, None] + step
            best = through.argmin(0)
            better = through[best, np.arange(k)] < dist - tiny
            dist[better], prev[better] = through[best, np.arange(k)][better], best[better]
        at = int(np.where(sinks, dist, np.inf).argmin())
        if not must and not (sinks[at] and dist[at] < -k * tiny):
            return flow
        path, end = [], at
        while prev[at] >= 0 and len(path) <= k:
            path.append((mover[prev[at], at], prev[at], at))
            at = prev[at]
        if any(g < 0 for g, _, _ in path):
            return None
        amount = min(flow[g, a] for g, a, _ in path)
        if must and sizes[at] > most:
            amount = min(amount, sizes[at] - most, most - sizes[end])
        elif must:
            amount = min(amount, sizes[at] - least, least - sizes[end])
        else:
            amount = min(amount, sizes[at] - least, most - sizes[end])
        for g, a, b in path:
            flow[g, a] -= amount
            flow[g, b] += amount
        sizes[at] -= amount
        sizes[end] += amount


def _movers(points: DataFrame, model: Priced, listed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, their cluster, their number, beyond): of each two clusters the cheapest movers, and what the next one costs."""
    k, d = model.centres.shape
    kind = "a int, b int, gap double, x array<double>, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                x = columns(batch.slice(at, STEP))["x"] + 0.0  # no negative zero
                cost, label = model.labels(x)
                for a in range(k):
                    own = np.flatnonzero(label == a)
                    for b in range(k):
                        if a != b and len(own):
                            rows = np.column_stack([cost[own, b] - cost[own, a], x[own]])
                            old, n = kept.get((a, b), (rows[:0], np.zeros(0, int)))
                            if len(old) > listed:
                                rows = rows[rows[:, 0] <= old[-1, 0]]
                            both, where = np.unique(np.concatenate([old, rows]), axis=0, return_inverse=True)
                            n = np.bincount(where.ravel(), np.concatenate([n, np.ones(len(rows))]), len(both)).astype(int)
                            kept[a, b] = both[: listed + 1], n[: listed + 1]
        for (a, b), (rows, n) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), a), pa.int32()), pa.array(np.full(len(n), b), pa.int32()), pa.array(rows[:, 0]), pa.array(list(rows[:, 1:]), pa.list_(pa.float64())), pa.array(n, pa.int64())],
                names=["a", "b", "gap", "x", "n"],
            )

    rows = points.select("id", "x").mapInArrow(run, kind).groupBy("a", "b", "gap", "x").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("gap", "x"))
    found = rows.withColumn("place", place).filter(F.col("place") <= listed + 1).collect()
    beyond, groups = np.full((k, k), np.inf), {}
    for r in found:
        if r.place > listed:
            beyond[r.a, r.b] = r.gap
        else:
            groups[tuple(r.x)] = (r.a, r.n)
    x = np.array(list(groups), float).reshape(len(groups), d)
    a, n = (np.array([g[i] for g in groups.values()], int) for i in (0, 1))
    return x, a, n, beyond


@dataclass
class Settled:
    """A priced model with the points that do not follow their prices: key of x to points by cluster."""

    model: Priced
    moved: dict[bytes, np.ndarray] = field(default_factory=dict)
    cost: float = np.inf
    means: np.ndarray | None = None

    def widest(self) -> float:
        """A bound on the difference of priced distances of points that were moved."""
        x = np.array([np.frombuffer(key) for key in self.moved])
        d = squares(x, self.model.centres) + self.model.prices
        return float((np.where(np.array(list(self.moved.values())) > 0, d, -np.inf).max(1) - d.min(1)).max()) * (1 + 1e-9)

    def labelled(self, points: DataFrame) -> DataFrame:
        """(id, label, pc1). Copies of one point that go to several clusters are dealt in the order of rows: each partition's
        number is counted first. ``points`` must be checkpointed, so that its partitions stay as they are."""
        moved, model = self.moved, self.model
        wide = self.widest() if moved else -1.0
        split = {key: i for i, (key, f) in enumerate(moved.items()) if (f > 0).sum() > 1}

        def found(x: np.ndarray) -> tuple[np.ndarray, list[tuple[bytes, np.ndarray]]]:
            """Labels by price, and the rows of each moved key."""
            d, label = model.labels(x)
            priced = np.sort(d + model.prices, 1)
            near = np.flatnonzero(priced[:, 1] - priced[:, 0] <= wide) if priced.shape[1] > 1 else np.zeros(0, int)
            keys, where = np.unique(x[near] + 0.0, axis=0, return_inverse=True)
            where = where.ravel()
            return label, [(key.tobytes(), near[where == i]) for i, key in enumerate(keys) if key.tobytes() in moved]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = dict.fromkeys(split, 0)
            for batch in batches:
                for key, rows in found(columns(batch)["x"])[1] if batch.num_rows else ():
                    if key in seen:
                        seen[key] += len(rows)
            yield batch_of("part int, which int, n long", np.full(len(seen), TaskContext.get().partitionId()), [split[key] for key in seen], list(seen.values()))

        before: dict[tuple[int, int], int] = {}
        if split:
            for r in points.select("id", "x").mapInArrow(count, "part int, which int, n long").groupBy("which").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).collect():
                at = 0
                for p in r.parts:
                    before[p.part, r.which] = at
                    at += p.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            at = {key: before[part, i] for key, i in split.items()}
            for batch in batches:
                if batch.num_rows:
                    x = columns(batch)["x"]
                    label, keyed = found(x)
                    for key, rows in keyed:
                        if key in at:
                            label[rows] = np.searchsorted(np.cumsum(moved[key]), at[key] + np.arange(len(rows)), "right")
                            at[key] += len(rows)
                        else:
                            label[rows] = moved[key].argmax()
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(label, pa.int32()), pa.array(x[:, 0])], names=["id", "label", "pc1"])

        return points.select("id", "x").mapInArrow(run, "id long, label int, pc1 double")


def settled(points: DataFrame, model: Priced, n: int, least: int, most: int) -> Settled:
    """The cheapest assignment to the model's centres with sizes in bounds: prices made sharper, then moves."""
    k, goal = len(model.centres), n / len(model.centres)
    best, sharp = None, model.soft
    for _ in range(PRICED):
        scan(points, {0: model})
        if not model.judged(goal):
            model.step(goal)
            continue
        left = float(np.maximum(model.hard - most, 0).sum() + np.maximum(least - model.hard, 0).sum())
        if best is None or left < best[0]:
            best = (left, Priced(model.centres, model.prices, model.soft, model.sums, model.hard, value=model.value))
        if left <= LEFT or model.soft < 1e-9 * sharp:
            break
        sharper = model.fits(goal)
        model.step(goal)
        if sharper:
            model.changed(soft=model.soft / 3)
    own = best[1]
    sizes, listed = own.hard.round().astype(int), LISTED
    while True:
        x, a, count, beyond = _movers(points, own, listed)
        cost, flow = squares(x, own.centres), np.zeros((len(x), k), int)
        flow[np.arange(len(x)), a] = count
        after = settle(cost, flow, sizes, least, most, beyond)
        if after is not None:
            break
        listed *= 4
    change = after - flow
    moved = {x[g].tobytes(): after[g] for g in np.flatnonzero((change != 0).any(1))}
    total = own.value - float((own.prices * own.hard).sum()) + float((change * cost).sum())
    held = sizes + change.sum(0)
    means = np.where(held[:, None] > 0, (own.sums + change.T @ x) / np.maximum(held, 1)[:, None], own.centres)
    return Settled(own, moved, total, means)


def _rest(points: DataFrame, models: dict[int, Priced], goal: float, rounds: int, wide: float, still: float) -> None:
    """Centres go to their clusters' means whenever prices fit them, until they move by ``still`` at most with sizes within
    ``wide`` of the goal, ``rounds`` times at most. One scan a step for all models."""
    moving, moved = dict(models), dict.fromkeys(models, 0)
    for _ in range(10 * rounds):
        if not moving:
            break
        scan(points, moving)
        for m, model in list(moving.items()):
            if not model.judged(goal):
                model.step(goal)
                continue
            off = float(np.abs(model.hard - goal).max())
            if off <= wide or model.off(goal) <= max(1.0, 0.01 * goal):
                new = model.means()
                shift = float(((new - model.centres) ** 2).sum())
                model.changed(new)
                moved[m] += 1
                if shift <= still and off <= wide or moved[m] >= rounds:
                    del moving[m]
            model.step(goal)


def fit(points: DataFrame, k: int, starts: int, slack: int, rounds: int = 40) -> tuple[DataFrame, Settled]:
    """(points, the cheapest model found) with sizes within ``slack`` of n // k, or what comes nearest to that.

    All starts move their centres and prices by one scan a step. The one whose priced bound is least is settled, and its
    centres follow the settled clusters until that lowers the cost no more.
    """
    base = Starts(points, [k], starts)
    base.seed_centres()
    n, goal = base.n, base.n / k
    least, most = max(0, n // k - slack), max(n // k + slack, -(-n // k))
    soft = SOFT * base.tolerance * 1e4 * len(base.low) or 1.0  # all points may be equal
    models = {m: Priced(c, np.zeros(k), soft) for m, c in enumerate(base.centres)}
    _rest(base.points, models, goal, rounds, max(slack, 0.05 * goal), base.tolerance)
    # Sharper prices around resting centres; any prices prove a bound, so the highest counts.
    bounds = dict.fromkeys(models, -np.inf)
    for _ in range(3):
        for model in models.values():
            model.changed(soft=model.soft / 3)
        open_ = dict(models)
        for _ in range(rounds):
            scan(base.points, open_)
            for m, model in list(open_.items()):
                bounds[m] = max(bounds[m], model.value - goal * float(model.prices.sum()))
                if model.judged(goal) and model.fits(goal):
                    del open_[m]
                model.step(goal)
            if not open_:
                break
    model = models[min(bounds, key=lambda m: bounds[m])]
    best: Settled | None = None
    for _ in range(rounds):
        # Prices alone let centres come near to their rest, so that few assignments must be settled.
        own = Priced(model.centres, model.prices, model.soft)
        _rest(base.points, {0: own}, goal, rounds, max(slack, 0.05 * goal), 1e-6 * base.tolerance)
        now = settled(base.points, Priced(own.centres, own.prices, own.soft), n, least, most)
        if best is not None and now.cost >= best.cost * (1 - 1e-6):
            return base.points, now if now.cost < best.cost else best
        best = now
        model = Priced(now.means, now.model.prices, own.soft)
    return base.points, best
