"""Follow-the-regularised-leader (proximal) updates with an elastic-net penalty."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of `features` rows and `outputs` columns; only rows that an example touches are ever changed."""

    def __init__(self, features: int, outputs: int, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.alpha, self.l1, self.l2, self.beta = alpha, l1, l2, beta
        self.z = np.zeros((features, outputs))
        self.n = np.zeros((features, outputs))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, rows: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        """`weights`: those of `rows` before; `rows` without repeats."""
        n = self.n[rows]
        new = n + gradient**2
        self.z[rows] += gradient - (np.sqrt(new) - np.sqrt(n)) / self.alpha * weights
        self.n[rows] = new


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
