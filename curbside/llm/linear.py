"""A logistic model fitted by Newton's method on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept

    @classmethod
    def constant(cls, columns: int, log_odds: float) -> Logistic:
        return cls(np.zeros(columns), np.ones(columns), np.append(np.zeros(columns), log_odds))

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 40) -> Logistic:
    """Weights for targets ``y`` between 0 and 1, with a ridge penalty on all but the intercept."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight / weight.mean()
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        hessian = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)
