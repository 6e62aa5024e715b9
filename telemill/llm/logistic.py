"""Logistic regression on sparse 0/1 features, for samples that fit on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def fit(row: np.ndarray, column: np.ndarray, rows: int, columns: int, target: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one the intercept, by Newton steps solved with conjugate gradients.

    ``row`` and ``column`` name the features that are 1; ``target`` may lie anywhere between 0 and 1.
    """
    weight = np.ones(rows) if weight is None else weight
    w = np.zeros(columns + 1)
    if not rows:
        return w
    w[-1] = logit(np.clip(np.average(target, weights=weight), 1e-4, 1 - 1e-4))
    keep = np.append(np.full(columns, ridge), 1e-6)

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, v[column], rows) + v[-1]

    def back(u: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, u[row], columns), u.sum())

    for _ in range(25):
        p = sigmoid(times(w))
        gradient = back(weight * (p - target)) + keep * w
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        scale = back(curve) + keep
        step, rest = np.zeros_like(w), -gradient
        along = rest / scale
        size = rest @ along
        for _ in range(60):
            if size < 1e-12:
                break
            turned = back(curve * times(along)) + keep * along
            far = size / (along @ turned)
            step += far * along
            rest = rest - far * turned
            ready = rest / scale
            size, old = rest @ ready, size
            along = ready + size / old * along
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return w
