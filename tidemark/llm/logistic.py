"""Ridge logistic regression on a small dense matrix (NumPy)."""

from __future__ import annotations


def predict(weights, x):
    """Probability of label 1; ``weights`` starts with the intercept."""
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def fit_logistic(x, y, ridge: float = 1.0, weight=None, steps: int = 25):
    """Newton steps; the intercept is not shrunk.  ``weight``: of each row."""
    import numpy as np

    x = np.column_stack([np.ones(len(x)), x])
    weight = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    shrink = np.full(x.shape[1], float(ridge))
    shrink[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - shrink * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(shrink)
        move = np.linalg.solve(curve, slope)
        size = np.abs(move).max()
        w = w + move * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-7:
            break
    return w
