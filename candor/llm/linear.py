"""Logistic regression by Newton's method on bounded, in-memory training matrices."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L2-penalised fit; the bias is not penalised.

    Of a single class or no rows there is nothing to learn: the weights are 0 and the bias 0.
    """
    d = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(d), 0.0
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(d + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ridge = np.full(d + 1, penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        slope = a.T @ (p - y) + ridge * w
        curve = (a * (p * (1 - p))[:, None]).T @ a
        curve[np.diag_indices_from(curve)] += ridge + 1e-9
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 8 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - mean @ weights)
