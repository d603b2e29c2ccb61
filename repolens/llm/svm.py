"""Linear support vector machines by dual coordinate descent, on sparse rows.

The rows are a bounded sample of labelled documents (the callers state the
bound); everything else about them is counted over all data elsewhere.
"""

from __future__ import annotations

import numpy as np

EPOCHS = 12


def dual_coordinate_descent(indices: list, values: list, labels: np.ndarray, features: int, cost=1.0, epochs: int = EPOCHS, seed: int = 1):
    """Hinge-loss linear SVM: row i has ``values[i]`` at ``indices[i]``, its
    label is 1 or -1, ``cost`` bounds the dual variables (one number, or one a
    row).  A constant feature stands for the bias.  Returns (weights, bias).

    Each step solves one dual variable exactly, in random order; a pass that
    changes nothing by much ends it."""
    n = len(labels)
    w, bias = np.zeros(features), 0.0
    alpha, upper = np.zeros(n), np.broadcast_to(np.asarray(cost, float), (n,))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(n):
            at, x, y = indices[i], values[i], labels[i]
            gradient = y * (w[at] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            step = new - alpha[i]
            if step:
                w[at] += (step * y) * x
                bias += step * y
                alpha[i] = new
                worst = max(worst, abs(step) * norm[i])
        if worst < 1e-3:
            break
    return w, bias


def sigmoid_scale(margin: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits the labels, by
    Newton steps on the logistic loss with targets drawn in a little."""
    pos, neg = int((labels > 0).sum()), int((labels <= 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, 0.0)
