"""Small logistic regressions on bounded tables of features."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, the last one is the intercept: Newton's method with a ridge on all but the intercept.

    ``y`` may hold probabilities.  The ridge is taken per row, so it doesn't fade as rows are added.
    """
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge * max(weight.sum(), 1.0))
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
