"""Logistic regression by accelerated gradient, for a few targets at once."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 300, still: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, targets) and biases, from rows x and targets y of 0 and 1. Ends after `rounds`, or once a round moves no weight by more than `still` of the largest."""
    n, d = x.shape
    y = y.reshape(n, -1).astype(np.float32)
    v = np.ones(d, np.float32) / np.sqrt(max(d, 1))
    top = 1.0
    for _ in range(12):  # the largest curvature, by power iteration
        u = x.T @ (x @ v) / n
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    step = 1 / (0.25 * (top * 1.1 + 1) + l2)
    w, b = np.zeros((d, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    pw, pb, t = w, b, 1.0
    for _ in range(rounds):
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / nt
        qw, qb = w + k * (w - pw), b + k * (b - pb)
        e = sigmoid(x @ qw + qb) - y
        pw, pb, t = w, b, nt
        w = (qw - step * (x.T @ e / n + l2 * qw)).astype(np.float32)
        b = (qb - step * e.mean(0)).astype(np.float32)
        if np.abs(w - pw).max(initial=0) <= still * np.abs(w).max(initial=0):
            break
    return w, b
