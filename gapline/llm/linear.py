"""Linear models over hashed sparse features, fitted on a bounded sample in numpy."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import SparkSession

DIM = 1 << 18
# Entries handled at once, so that what a fit holds beside its rows does not grow with them.
BLOCK = 1 << 19


@dataclass
class Rows:
    """Sparse rows: features of row i are index[cut[i]:cut[i + 1]] with their values; dense columns beside."""

    cut: np.ndarray
    index: np.ndarray
    value: np.ndarray
    dense: np.ndarray

    def __len__(self) -> int:
        return len(self.cut) - 1

    def pick(self, rows: np.ndarray) -> "Rows":
        cut = np.concatenate([[0], np.cumsum(np.diff(self.cut)[rows])]).astype(np.int64)
        index, value = np.empty(cut[-1], self.index.dtype), np.empty(cut[-1], self.value.dtype)
        for place, row in enumerate(rows):
            to, of = slice(cut[place], cut[place + 1]), slice(self.cut[row], self.cut[row + 1])
            index[to], value[to] = self.index[of], self.value[of]
        return Rows(cut, index, value, self.dense[rows])

    def with_dense(self, *columns: np.ndarray) -> "Rows":
        return Rows(self.cut, self.index, self.value, np.column_stack([self.dense, *columns]) if columns else self.dense)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.cut))

    def blocks(self):
        """(first row, row after the last) of runs with about BLOCK entries each."""
        edges = np.unique(np.append(np.searchsorted(self.cut, np.arange(0, self.cut[-1], BLOCK)), [0, len(self)]))
        return zip(edges[:-1].tolist(), edges[1:].tolist())

    def totals(self, weight: np.ndarray) -> np.ndarray:
        """Per feature the sum of its values, each times the weight of its row."""
        out = np.zeros(DIM)
        for a, b in self.blocks():
            part = slice(self.cut[a], self.cut[b])
            out += np.bincount(self.index[part], weights=np.repeat(weight[a:b], np.diff(self.cut[a : b + 1])) * self.value[part], minlength=DIM)
        return out

    def seen(self) -> np.ndarray:
        """Per feature the rows that have it."""
        out = np.zeros(DIM, np.int64)
        for at in range(0, len(self.index), BLOCK):
            out += np.bincount(self.index[at : at + BLOCK], minlength=DIM)
        return out


@dataclass
class Model:
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def predict(self, rows: Rows) -> np.ndarray:
        part = np.bincount(rows.owner(), weights=self.weights[rows.index] * rows.value, minlength=len(rows))
        return sigmoid(part + rows.dense @ self.dense + self.bias)


def send(spark: SparkSession, what):
    """Broadcast models; ``received`` gives them back in a task, also without this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(what))


def received(sent):
    return pickle.loads(sent.value)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def lbfgs(fun, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimise fun (value and gradient) with a backtracking line search."""
    value, grad = fun(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas)):
            q += (a - (y @ q) / (s @ y)) * s
        slope, step = -(grad @ q), 1.0 if past else 1.0 / max(1.0, np.abs(grad).sum())
        if slope > -1e-9:
            break
        for _ in range(20):
            new = x - step * q
            new_value, new_grad = fun(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        x, done = new, value - new_value < 1e-7 * max(1.0, abs(value))
        value, grad = new_value, new_grad
        if done:
            break
    return x


def fit(rows: Rows, target: np.ndarray, weight: np.ndarray, keep: int = 4096, least_rows: int = 5, penalty: float = 1.0, steps: int = 60) -> Model:
    """Logistic regression on targets in [0, 1].

    It has weights for at most ``keep`` features, those of at least ``least_rows`` rows that
    are most unlike the base rate; the others weigh 0.
    """
    total_weight = weight.sum()
    base = float(np.clip((weight @ target) / total_weight, 1e-6, 1 - 1e-6)) if total_weight else 0.5
    all_w = np.zeros(DIM)
    if len(rows) == 0 or min(target.max(), 1 - target.min()) <= 0 or target.max() == target.min():
        return Model(all_w, np.zeros(rows.dense.shape[1]), float(np.log(base / (1 - base))))
    even = weight * rows_norm(rows)
    mass, hits = rows.totals(even), rows.totals(even * target)
    odd = np.abs(hits - base * mass) / np.sqrt(base * (1 - base) * mass + 1e-3)
    odd[rows.seen() < least_rows] = -1
    chosen = np.argsort(-odd, kind="stable")[:keep]
    chosen = chosen[odd[chosen] > 0]
    place = np.full(DIM, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept = []  # (column, row, value) of the chosen features, block by block
    for a, b in rows.blocks():
        part = slice(rows.cut[a], rows.cut[b])
        col = place[rows.index[part]]
        use = col >= 0
        kept.append((col[use], np.repeat(np.arange(a, b, dtype=np.int32), np.diff(rows.cut[a : b + 1]))[use], rows.value[part][use]))
    k, d = len(chosen), rows.dense.shape[1]
    scale = 1.0 / max(1.0, total_weight)

    def loss(x):
        w, v, b = x[:k], x[k : k + d], x[-1]
        z = rows.dense @ v + b
        for col, row, val in kept:
            z += np.bincount(row, weights=w[col] * val, minlength=len(rows))
        err = weight * (sigmoid(z) - target)
        value = (weight @ (np.logaddexp(0, z) - target * z) + 0.5 * penalty * (w @ w + v @ v)) * scale
        grad = penalty * w
        for col, row, val in kept:
            grad += np.bincount(col, weights=err[row] * val, minlength=k)
        grad = np.concatenate([grad, rows.dense.T @ err + penalty * v, [err.sum()]])
        return value, grad * scale

    start = np.zeros(k + d + 1)
    start[-1] = np.log(base / (1 - base))
    x = lbfgs(loss, start, steps)
    all_w[chosen] = x[:k]
    return Model(all_w, x[k : k + d], float(x[-1]))


def rows_norm(rows: Rows) -> np.ndarray:
    """One over the largest value of a row's features, so that long rows weigh no more."""
    top = np.ones(len(rows))
    full = np.diff(rows.cut) > 0
    if len(rows.value):
        top[full] = np.maximum.reduceat(rows.value, rows.cut[:-1][full])
    return 1.0 / np.maximum(top, 1e-12)


def sparse(owner: np.ndarray, feature: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cut, index and count of the distinct features of each owner."""
    packed = np.sort(owner.astype(np.uint64) << np.uint64(18) | feature & np.uint64(DIM - 1))
    edge = np.flatnonzero(np.diff(packed, prepend=packed[:1] + np.uint64(1)))
    count = np.diff(edge, append=len(packed))
    packed = packed[edge]
    who = (packed >> np.uint64(18)).astype(np.int64)
    return np.searchsorted(who, np.arange(owners + 1)), (packed & np.uint64(DIM - 1)).astype(np.int64), count
