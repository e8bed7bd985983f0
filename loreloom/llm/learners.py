"""Two small models, trained here on samples of documented size: logistic regression and gradient-boosted trees of depth two."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Logistic regression by Newton steps with a ridge."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> Logistic:
        self.mean, self.std = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - self.mean) / self.std, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
            w -= np.linalg.solve(h, z.T @ (p - y) + ridge * len(x) * w)
        self.w = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.mean) / self.std, np.ones((len(x), 1))])
        return 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))


class Boosted:
    """Gradient boosting of depth-two trees on the logistic loss, with candidate thresholds at quantiles."""

    def __init__(self, rounds: int = 60, rate: float = 0.2, bins: int = 16):
        self.rounds, self.rate, self.bins = rounds, rate, bins

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[int, float]:
        best = (0.0, -1, 0.0)
        gs, hs = g[at].sum(), h[at].sum() + 1
        for f in range(x.shape[1]):
            for t in self.cuts[f]:
                left = x[at, f] <= t
                if not left.any() or left.all():
                    continue
                gl, hl = g[at][left].sum(), h[at][left].sum() + 1
                gain = gl * gl / hl + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / hs
                if gain > best[0]:
                    best = (gain, f, float(t))
        return best[1], best[2]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, self.bins))) for f in range(x.shape[1])]
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, self.trees = np.full(len(y), self.base), []
        everything = np.arange(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            f, t = self._split(x, g, h, everything)
            if f < 0:
                break
            tree = [(f, t)]
            leaves = []
            for side in (everything[x[:, f] <= t], everything[x[:, f] > t]):
                f2, t2 = self._split(x, g, h, side) if len(side) > 1 else (-1, 0.0)
                parts = [side] if f2 < 0 else [side[x[side, f2] <= t2], side[x[side, f2] > t2]]
                values = [self.rate * g[q].sum() / (h[q].sum() + 1) for q in parts]
                for q, v in zip(parts, values, strict=True):
                    score[q] += v
                leaves.append((f2, t2, values[0], values[-1]))
            self.trees.append((tree[0], leaves))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for (f, t), (left, right) in self.trees:
            go = x[:, f] <= t
            for side, (f2, t2, a, b) in ((go, left), (~go, right)):
                score[side] += a if f2 < 0 else np.where(x[side, f2] <= t2, a, b)
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))
