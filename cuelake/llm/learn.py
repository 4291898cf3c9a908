"""Small numpy learners on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Logistic regression on standardised columns by Newton steps with a ridge penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = x.std(axis=0) + 1e-6 if len(x) else np.ones(x.shape[1])
        n, k = len(y), x.shape[1] + 1
        self.w = np.zeros(k)
        rate = (y.sum() + 0.5) / (n + 1.0)
        self.w[-1] = np.log(rate / (1 - rate))
        if n and 0 < y.sum() < n:
            z = self._design(x)
            penalty = np.full(k, ridge)
            penalty[-1] = 1e-6
            for _ in range(steps):
                p = sigmoid(z @ self.w)
                grad = z.T @ (p - y) + penalty * self.w
                hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
                step = np.linalg.solve(hess, grad)
                self.w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
                if np.abs(step).max() < 1e-8:
                    break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -12, 12), np.ones((len(x), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._design(x) @ self.w)
