"""Models over a matrix in memory, which those over tables are held to."""
import numpy as np


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, assign=None, rounds: int = 100) -> tuple[np.ndarray, float]:
    """k-means++ start, then assignment and means in turn; (labels, inertia)."""
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        d = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
    labels = None
    for _ in range(rounds):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        new = d.argmin(1) if assign is None else assign(d)
        if labels is not None and (new == labels).all():
            break
        labels = new
        c = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(k)])
    return labels, float(d[np.arange(len(x)), labels].sum())


def balanced_assignment(cost: np.ndarray, least: int, most: int) -> np.ndarray:
    """Cheapest assignment with every cluster's size in [least, most]: points move along cheapest paths between clusters."""
    n, k = cost.shape
    if not least * k <= n <= most * k:
        raise ValueError("sizes cannot be met")
    labels = cost.argmin(1)
    while True:
        sizes = np.bincount(labels, minlength=k)
        if (sizes > most).any():
            sources, sinks = sizes > most, sizes < most
        elif (sizes < least).any():
            sources, sinks = sizes > least, sizes < least
        else:
            return labels
        step, mover = np.full((k, k), np.inf), np.zeros((k, k), int)
        for a in range(k):
            own = np.flatnonzero(labels == a)
            if len(own):
                extra = cost[own] - cost[own, a][:, None]
                step[a], mover[a] = extra.min(0), own[extra.argmin(0)]
        dist, prev = np.where(sources, 0.0, np.inf), np.full(k, -1)
        for _ in range(k):
            through = dist[:, None] + step
            best = through.argmin(0)
            better = through[best, np.arange(k)] < dist - 1e-12
            dist[better], prev[better] = through[best, np.arange(k)][better], best[better]
        at = int(np.where(sinks, dist, np.inf).argmin())
        moves = []
        while prev[at] >= 0 and len(moves) <= k:
            moves.append((mover[prev[at], at], at))
            at = prev[at]
        for point, to in moves:
            labels[point] = to
