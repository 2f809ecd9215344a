"""Sparse linear models trained by the follow-the-regularised-leader rule with elastic-net penalties."""

from __future__ import annotations

import numpy as np

#: A row's features: positions (unique) and values.
Row = tuple[np.ndarray, np.ndarray]


class Ftrl:
    """Logistic regression over ``size`` features plus a bias: multinomial, or of one output for ``classes`` = 1."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.001) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((size + 1, classes), np.float64), np.zeros((size + 1, classes), np.float64)
        self.bias = size

    def _row(self, row: Row) -> Row:
        return np.append(row[0], self.bias), np.append(row[1], 1.0)

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def fit(self, rows: list[Row], labels: list[int], epochs: int = 3, seed: int = 7) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                at, x = self._row(rows[i])
                w = self._weights(at)
                p = x @ w
                if len(p) == 1:
                    p = 1.0 / (1.0 + np.exp(-np.clip(p, -50, 50))) - labels[i]
                else:
                    p = softmax(p)
                    p[labels[i]] -= 1.0
                g = x[:, None] * p
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[at] = n + g * g
        return self

    def weights(self) -> np.ndarray:
        """(size + 1, classes); the last row is the bias."""
        return self._weights(np.arange(self.bias + 1))


def fit_binary(
    at: np.ndarray, start: np.ndarray, more: np.ndarray, labels: np.ndarray, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.001,
    epochs: int = 3, batch: int = 16, seed: int = 7, among: np.ndarray | None = None,
) -> np.ndarray:
    """Logistic regression by the same rule, some rows at a time: weights of ``size`` cells, of the columns of ``more``, and the bias.

    Row i has the cells ``at[start[i]:start[i + 1]]``, each with value 1; ``among`` are the rows to fit, by default all.
    """
    k = more.shape[1]
    z, n = np.zeros(size + k + 1), np.zeros(size + k + 1)
    y, order = labels.astype(float), np.random.default_rng(seed)
    dense_at = np.arange(size, size + k + 1)
    among = np.arange(len(y)) if among is None else among
    for _ in range(epochs):
        mixed = among[order.permutation(len(among))]
        for a in range(0, len(mixed), batch):
            rows = mixed[a : a + batch]
            cells = np.concatenate([at[start[i] : start[i + 1]] for i in rows])
            row = np.repeat(np.arange(len(rows)), start[rows + 1] - start[rows])
            own, place = np.unique(cells, return_inverse=True)
            touched = np.concatenate([own, dense_at])
            zt, nt = z[touched], n[touched]
            w = np.where(np.abs(zt) <= l1, 0.0, -(zt - np.sign(zt) * l1) / ((beta + np.sqrt(nt)) / alpha + l2))
            x = np.column_stack([more[rows], np.ones(len(rows))])
            margin = np.bincount(row, weights=w[place], minlength=len(rows)) + x @ w[len(own) :]
            p = 1.0 / (1.0 + np.exp(-np.clip(margin, -50, 50))) - y[rows]
            g = np.concatenate([np.bincount(place, weights=p[row], minlength=len(own)), p @ x])
            z[touched] = zt + g - (np.sqrt(nt + g * g) - np.sqrt(nt)) / alpha * w
            n[touched] = nt + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sparse(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are not all zero: positions and values."""
    at = np.flatnonzero(np.any(weights != 0, axis=1))
    return at.astype(np.int32), weights[at].astype(np.float32)


def dense(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, values.shape[1]), np.float32)
    out[at] = values
    return out
