"""A small logistic model, fitted on the driver from a bounded matrix."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels ``y`` by full gradient steps (Adam), in a fixed number of steps."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = (weight / weight.sum()).astype(np.float32)
    for t in range(1, steps + 1):
        r = weight * (sigmoid(x @ w + b) - y).astype(np.float32)
        g, gb = x.T @ r + l2 * w, float(r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)
