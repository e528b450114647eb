"""Small recurrent networks in numpy: layers with their gradients, and Adam. Arrays are time-major: (steps, rows, units)."""
from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def init(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)


class Adam:
    def __init__(self, params: Params, rate: float = 0.01):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: Params, most: float = 5.0) -> None:
        self.step += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, most / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.step), self.v[k] / (1 - 0.99**self.step)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def gru(x: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """x: (T, B, 3H) projected inputs (update, reset, candidate); u: (H, 3H). All states, and what ``gru_back`` needs."""
    steps, rows, width = x.shape
    n = width // 3
    h, out, tape = np.zeros((rows, n), np.float32), np.empty((steps, rows, n), np.float32), []
    for t in range(steps):
        r = h @ u
        zr = sigmoid(x[t, :, : 2 * n] + r[:, : 2 * n])
        z, c = zr[:, :n], np.tanh(x[t, :, 2 * n :] + zr[:, n:] * r[:, 2 * n :])
        if keep:
            tape.append((h, zr, c, r[:, 2 * n :]))
        h = c + z * (h - c)
        out[t] = h
    return out, tape


def gru_back(d_out: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    steps, rows, n = d_out.shape
    dx, du, dh = np.empty((steps, rows, 3 * n), np.float32), np.zeros_like(u), np.zeros((rows, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, zr, c, rc = tape[t]
        z, r = zr[:, :n], zr[:, n:]
        dh = dh + d_out[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * rc * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dc], 1)
        dr_all = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ dr_all
        dh = dh * z + dr_all @ u.T
    return dx, du


def gate(x: np.ndarray) -> np.ndarray:
    """The hard sigmoid, which costs a fraction of the smooth one."""
    return np.clip(np.float32(0.25) * x + np.float32(0.5), np.float32(0), np.float32(1))


def soft(x: np.ndarray) -> np.ndarray:
    """The softsign, in the place of the dearer tanh."""
    return x / (np.float32(1) + np.abs(x))


def lstm(x: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """x: (T, B, 4H) projected inputs (input, forget, output, candidate); u: (H, 4H). Gates are hard sigmoids, states softsigns."""
    steps, rows, width = x.shape
    n = width // 4
    h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
    out, tape = np.empty((steps, rows, n), np.float32), []
    for t in range(steps):
        a = x[t] + h @ u
        g, k = gate(a[:, : 3 * n]), soft(a[:, 3 * n :])
        before = c
        c = g[:, n : 2 * n] * c + g[:, :n] * k
        s = soft(c)
        if keep:
            tape.append((h, before, g, k, s))
        h = g[:, 2 * n :] * s
        out[t] = h
    return out, tape


def lstm_back(d_out: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    steps, rows, n = d_out.shape
    dx, du = np.empty((steps, rows, 4 * n), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, before, g, k, s = tape[t]
        i, f, o = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :]
        slope = np.float32(0.25) * ((g > 0) & (g < 1))
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - np.abs(s)) ** 2
        d = np.concatenate([np.concatenate([dc * k, dc * before, dh * s], 1) * slope, dc * i * (1 - np.abs(k)) ** 2], 1)
        dx[t] = d
        du += h.T @ d
        dh, dc = d @ u.T, dc * f
    return dx, du


class LstmReader:
    """All states of an LSTM over symbols, as ``lstm`` gives them; gates lie apart and buffers are used again, for speed."""

    def __init__(self, table: np.ndarray, u: np.ndarray):
        """table: (symbols, 4H) projected inputs."""
        n = len(u)
        scale, shift = np.ones(4 * n, np.float32), np.zeros(4 * n, np.float32)
        scale[: 3 * n], shift[: 3 * n] = 0.25, 0.5
        self.tables = [np.ascontiguousarray(t) for t in np.split(table * scale + shift, 4, 1)]
        self.u, self.n, self.rows = np.stack(np.split(u * scale, 4, 1)), n, -1

    def read(self, symbols: np.ndarray, out: np.ndarray, back: bool = False) -> None:
        """symbols: (T, B) intp; out: (T, B, H)."""
        steps, rows = symbols.shape
        n, zero, one = self.n, np.float32(0), np.float32(1)
        if rows != self.rows:
            self.rows = rows
            self.x, self.a = np.empty((4, rows, n), np.float32), np.empty((4, rows, n), np.float32)
            self.c, self.s, self.r = (np.empty((rows, n), np.float32) for _ in range(3))
        x, a, c, s, r = self.x, self.a, self.c, self.s, self.r
        gates, (i, f, o, k) = a[:3], a
        h = np.zeros((rows, n), np.float32)
        c[:] = 0
        for t in range(steps - 1, -1, -1) if back else range(steps):
            for table, to in zip(self.tables, x):
                table.take(symbols[t], axis=0, out=to, mode="clip")
            np.matmul(h, self.u, out=a)
            np.add(a, x, out=a)
            np.maximum(gates, zero, out=gates)
            np.minimum(gates, one, out=gates)
            np.abs(k, out=r)
            np.add(r, one, out=r)
            np.divide(k, r, out=k)
            np.multiply(c, f, out=c)
            np.multiply(i, k, out=s)
            np.add(c, s, out=c)
            np.abs(c, out=r)
            np.add(r, one, out=r)
            np.divide(c, r, out=s)
            h = out[t]
            np.multiply(o, s, out=h)


def scatter_rows(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by ``index`` below n."""
    out = np.zeros((n, values.shape[-1]), np.float32)
    order = np.argsort(index, kind="stable")
    keys = index[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    out[keys[starts]] = np.add.reduceat(values[order], starts)
    return out
