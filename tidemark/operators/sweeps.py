"""Many small models over the same points, advanced together: one scan of the points a step, whatever the number of models.

Parameters of all models (centres, mixture components) are in the driver and are sent to every task; a task gives sums for each
of them, which Spark adds up. What is drawn at random follows from a seed, the model and the row's id, so tasks draw where the
rows are: k-means++ takes each next centre by a race (the largest of weight and noise), and the reference sets of the gap
statistic are made in place and never sent.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship
from .blocks import nested
from .near import Placed, Rows, batch_of, columns, visit

#: Rows of points that a task reads at once, and that models are compared with at once; centres of a group of models, few enough
#: for distances to stay in a core's cache; clusters of which sums of distances are a product of matrices.
STEP, CHUNK, WIDE, FEW = 4096, 1024, 128, 16


def mixed(x: np.ndarray, *key: int) -> np.ndarray:
    """Hashes that follow from hashes and the key; more of a key may follow later."""
    with np.errstate(over="ignore"):
        for k in key:
            x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return x


def hashed(ids: np.ndarray, *key: int) -> np.ndarray:
    return mixed(ids.astype(np.uint64), 0x9E3779B97F4A7C15, *key)


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


def uniform(ids: np.ndarray, *key: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from the ids and the key."""
    return unit(hashed(ids, *key))


def _parts(batches: Iterator[pa.RecordBatch], step: int = STEP) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield tuple(columns(batch.slice(at, step)).values())


def totals(points: DataFrame, measure: Callable[..., Iterable[tuple[int, np.ndarray]]], *more: str) -> dict[int, np.ndarray]:
    """Sums over all points of the vectors that ``measure`` (ids, x, more columns) gives for each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in _parts(batches):
            for model, v in measure(*rows):
                sums[model] = sums[model] + v if model in sums else v
        if sums:
            sizes = [len(v) for v in sums.values()]
            yield batch_of("model int, i int, v double", np.repeat(list(sums), sizes), np.concatenate([np.arange(n) for n in sizes]), np.concatenate(list(sums.values())))

    found = points.select("id", "x", *more).mapInArrow(run, "model int, i int, v double").groupBy("model", "i").agg(F.sum("v").alias("v")).toArrow()
    out: dict[int, np.ndarray] = {}
    model, i, v = (found.column(c).to_numpy() for c in ("model", "i", "v"))
    for m in np.unique(model):
        at = model == m
        out[int(m)] = np.zeros(at.sum())
        out[int(m)][i[at]] = v[at]
    return out


def winners(points: DataFrame, race: Callable[[np.ndarray, np.ndarray], Iterable[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, np.ndarray]:
    """For each model the point with the largest value; ``race`` (ids, x) of CHUNK rows gives (model, values, points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int, list[float]]] = {}
        for ids, x in _parts(batches, CHUNK):
            for model, value, own in race(ids, x):
                at = int(value.argmax())
                if model not in best or value[at] > best[model][0]:
                    best[model] = (float(value[at]), int(ids[at]), own[at].tolist())
        if best:
            values, who, xs = zip(*best.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(values, pa.float64()), pa.array(who, pa.int64()), pa.array(xs, pa.list_(pa.float64()))], names=["model", "value", "id", "x"])

    rows = points.select("id", "x").mapInArrow(run, "model int, value double, id long, x array<double>").groupBy("model").agg(F.max_by("x", F.struct("value", "id")).alias("x")).collect()
    return {r.model: np.array(r.x) for r in rows}


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, coordinate by coordinate; in memory a row for each of ``c``, so that long rows are worked on."""
    out = np.zeros((len(c), len(x)))
    for j in range(x.shape[1]):
        d = x[:, j] - c[:, j, None]
        d *= d
        out += d
    return out.T


def split(models: list[int], k: int) -> Iterator[list[int]]:
    """Models of ``k`` clusters in parts that have WIDE centres or one model."""
    n = max(1, WIDE // k)
    return (models[at : at + n] for at in range(0, len(models), n))


class Group:
    """Models of as many clusters over the same coordinates of one set, whose distances to points are one product of matrices."""

    def __init__(self, models: list[int], centres: list[np.ndarray], origin: np.ndarray):
        self.models, self.k, self.width = models, len(centres[0]), centres[0].shape[1]
        self.exact = np.stack(centres, 1)  # cluster, model, coordinate
        own = self.exact - origin[: self.width]
        self.matrix = np.concatenate([-2 * own, (own * own).sum(2, keepdims=True)], 2).reshape(-1, self.width + 1)

    def reduced(self, rows: np.ndarray) -> np.ndarray:
        """(cluster, model and point): squared distances less the points' squared norms. ``rows``: coordinates less the origin."""
        ones = np.ones((1, rows.shape[1]))
        return (self.matrix @ np.concatenate([rows[: self.width], ones])).reshape(self.k, -1)

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """(cluster, model, coordinate and number) of the points that are nearest to each, the first of equally near ones."""
        d = self.reduced(rows)
        right = np.concatenate([rows[: self.width], np.ones((1, rows.shape[1]))]).T

        def total(own: np.ndarray) -> np.ndarray:
            return (own.reshape(-1, rows.shape[1]).astype(float) @ right).reshape(self.k, -1, self.width + 1)

        out = total(d == d.min(0))
        if out[:, :, -1].sum() != len(self.models) * rows.shape[1]:
            out = total(np.arange(self.k)[:, None] == d.argmin(0))
        return out

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        """(model, point): squared distances to the nearest, so far as a product of matrices tells them."""
        own = rows[: self.width]
        return np.maximum(self.reduced(rows).min(0).reshape(-1, rows.shape[1]) + (own * own).sum(0), 0)

    def cost(self, x: np.ndarray) -> np.ndarray:
        """Of each model the sum of squared distances to the nearest, from differences."""
        d = np.zeros((self.k, len(self.models), len(x)))
        for j in range(self.width):
            one = x[:, j] - self.exact[:, :, j, None]
            one *= one
            d += one
        return d.min(0).sum(1)


class Starts:
    """A grid of k-means models (k, reference set or -1 for the points themselves, start) with their centres.

    ``leading``: a model of k clusters sees the first k coordinates only. ``first``: the whole grid is there for each of these
    numbers of first coordinates. Models of one k, set and number of coordinates are worked on together.
    """

    def __init__(self, points: DataFrame, ks: Iterable[int], starts: int, boots: Iterable[int] = (-1,), seed: int = 0, leading: bool = False, first: Iterable[int] = ()):
        ship(points.sparkSession)
        ensure_checkpoint_dir(points.sparkSession)
        points = points.select("id", "x")
        tasks = points.sparkSession.sparkContext.defaultParallelism
        self.points = (points.repartition(tasks) if points.rdd.getNumPartitions() < tasks else points).checkpoint()  # scanned many times
        self.seed = seed
        first = list(first)
        self.names = [(k, b, s) for b in boots for _ in first or (0,) for k in ks for s in range(starts)]
        head = self.points.agg(F.count("*").alias("n")).first()
        self.n = head.n
        if not self.n:
            raise ValueError("no points")
        moments = totals(self.points, lambda ids, x: [(0, x.sum(0)), (1, (x * x).sum(0))])
        spread = np.maximum(moments[1] / self.n - (moments[0] / self.n) ** 2, 0)
        box = winners(self.points, lambda ids, x: [(j + side * x.shape[1], (1 - 2 * side) * x[:, j], x) for j in range(x.shape[1]) for side in (0, 1)])
        d = len(moments[0])
        self.high, self.low = (np.array([box[j + side * d][j] for j in range(d)]) for side in (0, 1))
        self.widths = [w for _ in boots for w in first for _ in ks for _ in range(starts)] if first else [min(k, d) if leading else d for k, _, _ in self.names]
        self.tolerance, *self.rests = (1e-4 * float(np.mean(spread[:w])) for w in (d, *self.widths))
        self.centres: list[np.ndarray] = [np.zeros((0, w)) for w in self.widths]
        self.cost = np.full(len(self.names), np.inf)

    def reference(self, boot: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Points of a reference set, uniform in the box of all points, from hashes of ids and seed; of -1, the points."""
        low, span = self.low, self.high - self.low

        def make(begun: np.ndarray, x: np.ndarray) -> np.ndarray:
            if boot < 0:
                return x
            own = mixed(begun, boot)
            return low + span * np.stack([unit(mixed(own, j)) for j in range(len(low))], 1)

        return make

    def _sets(self, models: list[int]) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, list[Group]]]]]]:
        """Of every CHUNK of rows the hashes of ids and seed, and for each set its points, these less an origin by coordinates, and
        the models' groups."""
        by_set: dict[int, dict[tuple[int, int], list[int]]] = {}
        for m in models:
            k, b, _ = self.names[m]
            by_set.setdefault(b, {}).setdefault((k, self.widths[m]), []).append(m)
        origin, seed = (self.low + self.high) / 2, self.seed
        sets = [(self.reference(b), [Group(part, [self.centres[m] for m in part], origin) for (k, _), own in groups.items() for part in split(own, k)]) for b, groups in by_set.items()]

        def run(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, list]]:
            for at in range(0, len(ids), CHUNK):
                begun, rows = hashed(ids[at : at + CHUNK], seed), x[at : at + CHUNK]
                made = [(make(begun, rows), groups) for make, groups in sets]
                yield begun, [(data, np.ascontiguousarray((data - origin).T), groups) for data, groups in made]

        return run

    def seed_centres(self) -> None:
        """k-means++ for all models at once, a centre of each a scan."""
        names = self.names
        for step in range(max(k for k, _, _ in names)):
            models = [m for m, (k, _, _) in enumerate(names) if k > step]
            chunks = self._sets(models)

            def race(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
                for begun, sets in chunks(ids, x):  # noqa: B023
                    drawn: dict[tuple[int, int], np.ndarray] = {}  # the same for all sets
                    by_start: dict[int, np.ndarray] = {}
                    for data, rows, groups in sets:
                        for group in groups:
                            weight = group.nearest(rows) + 1e-300 if step else np.ones((len(group.models), len(begun)))  # noqa: B023
                            for i, m in enumerate(group.models):
                                k, _, s = names[m]
                                if s not in by_start:
                                    by_start[s] = mixed(begun, 7 + s)
                                if (k, s) not in drawn:
                                    drawn[k, s] = -1 / np.log(unit(mixed(by_start[s], k, step)))  # noqa: B023
                                yield m, weight[i] * drawn[k, s], data[:, : group.width]

            found = winners(self.points, race)
            for m in models:
                self.centres[m] = np.vstack([self.centres[m], found[m]])

    def _sums(self, models: list[int]) -> dict[int, np.ndarray]:
        """Of each model the sums of its clusters' points and their numbers."""
        chunks, origin = self._sets(models), (self.low + self.high) / 2

        def measure(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            for _, sets in chunks(ids, x):
                for _, rows, groups in sets:
                    for group in groups:
                        found = group.sums(rows)
                        found[:, :, :-1] += found[:, :, -1:] * origin[: group.width]
                        for i, m in enumerate(group.models):
                            yield m, np.concatenate([found[:, i, :-1].ravel(), found[:, i, -1]])

        return totals(self.points, measure)

    def _costs(self) -> dict[int, np.ndarray]:
        """Of every model the sum of squared distances to the nearest centres."""
        chunks = self._sets(list(range(len(self.names))))

        def measure(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            for _, sets in chunks(ids, x):
                for data, _, groups in sets:
                    for group in groups:
                        for m, cost in zip(group.models, group.cost(data)):
                            yield m, np.array([cost])

        return totals(self.points, measure)

    def run(self, rounds: int = 300) -> Starts:
        """Lloyd's algorithm for all models until their centres rest; a centre without points stays where it is."""
        self.seed_centres()
        moving = list(range(len(self.names)))
        for _ in range(rounds):
            if not moving:
                break
            still = []
            for m, v in self._sums(moving).items():
                k, d = self.centres[m].shape
                count = v[k * d :]
                new = np.where(count[:, None] > 0, v[: k * d].reshape(k, d) / np.maximum(count, 1)[:, None], self.centres[m])
                shift = float(((new - self.centres[m]) ** 2).sum())
                self.centres[m] = new
                if shift > self.rests[m]:
                    still.append(m)
            moving = still
        for m, v in self._costs().items():
            self.cost[m] = v[0]
        return self

    def best(self, width: int | None = None) -> dict[tuple[int, int], int]:
        """(k, boot): the cheapest start, of those over ``width`` coordinates."""
        out: dict[tuple[int, int], int] = {}
        for m, (k, b, _) in enumerate(self.names):
            if width is not None and self.widths[m] != width:
                continue
            if (k, b) not in out or self.cost[m] < self.cost[out[k, b]]:
                out[k, b] = m
        return out


def labelled(points: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """``points`` with ``labels``: of each set of centres the nearest, an array; by as many coordinates as centres have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = columns(batch.select(["x"]))["x"]
                found = np.stack([squares(x[:, : c.shape[1]], c).argmin(1) for c in centres], 1).astype(np.int32)
                yield batch.append_column("labels", pa.array(list(found), pa.list_(pa.int32())))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{kinds}, labels array<int>")


class Mixture:
    """Weights, means and covariance (diagonals, one matrix, or one each) of a mixture of Gaussians."""

    def __init__(self, kind: str, weights: np.ndarray, means: np.ndarray, cov: np.ndarray):
        self.kind, self.weights, self.means, self.cov = kind, weights, means, cov
        if kind != "diag":
            self.low = np.linalg.cholesky(cov if cov.ndim == 3 else cov[None])

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of weighted densities."""
        out = np.empty((len(x), len(self.means)))
        for j, m in enumerate(self.means):
            d = x - m
            if self.kind == "diag":
                out[:, j] = -0.5 * ((d * d / self.cov[j]).sum(1) + np.log(2 * np.pi * self.cov[j]).sum())
            else:
                low = self.low[min(j, len(self.low) - 1)]
                z = np.linalg.solve(low, d.T)
                out[:, j] = -0.5 * ((z * z).sum(0) + x.shape[1] * math.log(2 * math.pi)) - np.log(np.diag(low)).sum()
        return out + np.log(self.weights)

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of components in each point, and the points' log-likelihoods."""
        logs = self.logs(x)
        top = logs.max(1, keepdims=True)
        total = np.log(np.exp(logs - top).sum(1)) + top[:, 0]
        return np.exp(logs - total[:, None]), total


def statistics(resp: np.ndarray, x: np.ndarray, total: float) -> np.ndarray:
    """Sums of shares, of points and of products of two coordinates by component, and the log-likelihood."""
    second = np.einsum("nk,ni,nj->kij", resp, x, x, optimize=True)
    return np.concatenate([resp.sum(0), (resp.T @ x).ravel(), second.ravel(), [total]])


def maximise(v: np.ndarray, k: int, d: int, kind: str, n: int) -> Mixture:
    """The mixture that the sums ask for."""
    w = v[:k] + 1e-10
    means = v[k : k + k * d].reshape(k, d) / w[:, None]
    each = v[k + k * d : -1].reshape(k, d, d) - w[:, None, None] * means[:, :, None] * means[:, None, :]
    if kind == "diag":
        cov = np.maximum(np.einsum("kii->ki", each) / w[:, None], 0) + 1e-6
    elif kind == "tied":
        cov = each.sum(0) / n + 1e-6 * np.eye(d)
    else:
        cov = each / w[:, None, None] + 1e-6 * np.eye(d)
    return Mixture(kind, w / n, means, cov)


def mixtures(points: DataFrame, grid: list[tuple[int, str]], starts: int = 10, seed: int = 0, rounds: int = 300, tol: float = 1e-3) -> dict[tuple[int, str], tuple[float, Mixture]]:
    """Of each (k, covariance) the best of some starts: mean log-likelihood and mixture. A start that breaks down is left out.

    Every start begins at k-means labels of its own; all are advanced by one scan a round until the mean log-likelihood rests.
    """
    base = Starts(points, sorted({k for k, _ in grid}), starts, seed=seed).run()
    n, d = base.n, len(base.low)
    centres = {(k, s): base.centres[m] for m, (k, _, s) in enumerate(base.names)}
    models: list[Mixture | None] = []
    names = [(k, kind, s) for k, kind in grid for s in range(starts)]

    def first(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for m, ((k, s), c) in enumerate(centres.items()):
            yield m, statistics(np.eye(k)[squares(x, c).argmin(1)], x, 0.0)

    points = base.points
    sums = totals(points, first)
    of = {name: sums[m] for m, name in enumerate(centres)}

    def fit(v: np.ndarray, k: int, kind: str) -> Mixture | None:
        try:
            return maximise(v, k, d, kind, n)
        except np.linalg.LinAlgError:
            return None

    models = [fit(of[k, s], k, kind) for k, kind, s in names]
    before = np.full(len(names), -np.inf)
    moving = [m for m, found in enumerate(models) if found]
    for _ in range(rounds):
        if not moving:
            break
        now = {m: models[m] for m in moving}

        def expect(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            for m, mixture in now.items():  # noqa: B023
                resp, total = mixture.responsibilities(x)
                yield m, statistics(resp, x, float(total.sum()))

        still = []
        for m, v in totals(points, expect).items():
            likelihood = v[-1] / n
            rests, before[m] = abs(likelihood - before[m]) < tol, likelihood
            if not rests:
                k, kind, _ = names[m]
                models[m] = fit(v, k, kind)
                if models[m]:
                    still.append(m)
                else:
                    before[m] = -np.inf
        moving = still
    out: dict[tuple[int, str], tuple[float, Mixture]] = {}
    for m, (k, kind, _) in enumerate(names):
        if models[m] and np.isfinite(before[m]) and ((k, kind) not in out or before[m] > out[k, kind][0]):
            out[k, kind] = (float(before[m]), models[m])
    return out


class _Silhouettes:
    """Sums of the silhouettes of a block's points, of all labellings at once; labels under 0 are no points of a labelling.

    ``widths``: how many of the first coordinates each labelling's distances are over.
    """

    def __init__(self, own: Rows, counts: list[np.ndarray], widths: list[int]):
        self.own, self.counts, self.widths = own, counts, widths
        self.sums = [np.zeros((len(own["id"]), len(c))) for c in counts]

    def see(self, other: Rows) -> None:
        # Points near each other have few different rows of labels: distances are summed by these, then by label.
        rows, which = np.unique(other["labels"], axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        x, first = other["x"][order], np.searchsorted(which[order], np.arange(len(rows)))
        for width, d in nested(self.own["x"], x, sorted(set(self.widths))):
            mine = [l for l, w in enumerate(self.widths) if w == width]
            few = [l for l in mine if self.sums[l].shape[1] <= FEW]
            if len(rows) <= 2 * FEW:
                part, label = d @ (which[order][:, None] == np.arange(len(rows))).astype(float), rows
            elif 4 * len(rows) <= len(order):
                part, label = np.add.reduceat(d, first, axis=1), rows
            else:
                part, label = d, other["labels"][order]
            if few:
                found = part @ np.concatenate([label[:, [l]] == np.arange(self.sums[l].shape[1]) for l in few], 1).astype(float)
                for l, s in zip(few, np.split(found, np.cumsum([self.sums[l].shape[1] for l in few])[:-1], 1)):
                    self.sums[l] += s
            for l in mine:
                some = np.flatnonzero(label[:, l] >= 0)
                if l not in few and len(some):
                    some = some[np.argsort(label[some, l], kind="stable")]
                    names, begin = np.unique(label[some, l], return_index=True)
                    self.sums[l][:, names] += np.add.reduceat(part[:, some], begin, axis=1)

    def absorb(self, part: _Silhouettes) -> None:
        for s, more in zip(self.sums, part.sums):
            s += more

    def each(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each labelling its rows and their silhouettes."""
        for l, (s, count) in enumerate(zip(self.sums, self.counts)):
            rows = np.flatnonzero(self.own["labels"][:, l] >= 0)
            label, s = self.own["labels"][rows, l], s[rows]
            at = np.arange(len(rows))
            inner = s[at, label] / np.maximum(count[label] - 1, 1)
            outer = np.where(count > 0, s / np.maximum(count, 1), np.inf)
            outer[at, label] = np.inf
            b = outer.min(1, initial=np.inf)
            top = np.maximum(inner, b)
            good = (count[label] > 1) & np.isfinite(b) & (top > 0)
            out = np.zeros(len(rows))
            out[good] = (b - inner)[good] / top[good]
            yield rows, out

    def done(self) -> pa.RecordBatch:
        found = [(float(s.sum()), len(rows)) for rows, s in self.each()]
        return batch_of("labelling int, s double, n long", np.arange(len(found)), *zip(*found))


class _Each(_Silhouettes):
    """The silhouettes of one labelling."""

    def done(self) -> pa.RecordBatch:
        ((rows, s),) = self.each()
        return batch_of("id long, code int, s double", self.own["id"][rows], self.own["labels"][rows, 0], s)


def silhouettes(points: DataFrame, counts: list[np.ndarray], widths: list[int] | None = None) -> list[float | None]:
    """Mean silhouette of each of ``labels`` (an array by point), with the sizes of its clusters; pairs of blocks meet once for all.

    ``widths``: how many of the first coordinates each is over; all of them, unless given.
    """
    if not sum(int(c.sum()) for c in counts):
        return [None] * len(counts)
    # What is noise in all labellings has no silhouette and is in nobody's.
    placed = Placed(points.filter(F.exists("labels", lambda v: v >= 0)).select("id", "x", "labels"))
    widths = widths or [placed.bounds.pivots.shape[1]] * len(counts)
    rows = visit(placed.rows, placed.near(math.inf), lambda own: _Silhouettes(own, counts, widths), "labelling int, s double, n long")
    found = {r.labelling: (r.s, r.n) for r in rows.groupBy("labelling").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    return [found[l][0] / found[l][1] if l in found and found[l][1] else None for l in range(len(counts))]


def scores(points: DataFrame, sizes: list[int], widths: list[int] | None = None) -> list[dict[str, float | None]]:
    """inertia, silhouette, calinski_harabasz and davies_bouldin of each of ``labels`` (an array by point), numbered below ``sizes``.

    ``widths``: how many of the first coordinates each is over; all of them, unless given.
    """
    ship(points.sparkSession)
    points = points.select("id", "x", "labels").checkpoint()

    def sums(ids: np.ndarray, x: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for l, k in enumerate(sizes):
            one = (labels[:, [l]] == np.arange(k)).astype(float)
            yield l, np.concatenate([one.sum(0), (one.T @ x).ravel()])

    first = totals(points, sums, "labels")
    counts = [first[l][:k] for l, k in enumerate(sizes)]
    means = [first[l][k:].reshape(k, -1) / np.maximum(first[l][:k], 1)[:, None] for l, k in enumerate(sizes)]
    if widths:
        means = [m[:, :w] for m, w in zip(means, widths)]

    def spreads(ids: np.ndarray, x: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for l, k in enumerate(sizes):
            own = labels[:, l] >= 0
            d = ((x[own, : means[l].shape[1]] - means[l][labels[own, l]]) ** 2).sum(1)
            yield l, np.concatenate([np.bincount(labels[own, l], np.sqrt(d), k), [d.sum()]])

    second = totals(points, spreads, "labels")
    out = []
    for l, silhouette in enumerate(silhouettes(points, counts, widths)):
        n, m = counts[l][counts[l] > 0], means[l][counts[l] > 0]
        spread, within, k = second[l][:-1][counts[l] > 0] / n, float(second[l][-1]), len(n)
        between = float((n * ((m - (n[:, None] * m).sum(0) / n.sum()) ** 2).sum(1)).sum()) if k else 0.0
        ratio = 1.0 if within == 0 else between * (n.sum() - k) / (within * (k - 1)) if k > 1 else None
        gap = np.sqrt(squares(m, m))
        np.fill_diagonal(gap, np.inf)
        worst = np.where(gap > 0, (spread[:, None] + spread) / np.where(gap > 0, gap, 1), 0.0)
        out.append({"inertia": within, "silhouette": silhouette, "calinski_harabasz": None if ratio is None else float(ratio), "davies_bouldin": float(worst.max(1).mean()) if k > 1 else None})
    return out
