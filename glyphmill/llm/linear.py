"""Hashed logistic and softmax regression in numpy."""

from __future__ import annotations

import numpy as np


class HashedLogistic:
    """Logistic regression on lists of hashed binary features."""

    def __init__(self, bits: int = 18):
        self.bits = bits
        self.weight = np.zeros(1 << bits, dtype=np.float32)

    def slots(self, features: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
        flat = np.fromiter((f for row in features for f in row), dtype=np.int64, count=int(sizes.sum()))
        return flat & ((1 << self.bits) - 1), sizes

    def margin(self, features: list[list[int]]) -> np.ndarray:
        flat, sizes = self.slots(features)
        total = np.concatenate(([0.0], np.cumsum(self.weight[flat], dtype=np.float64)))
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def fit(self, features: list[list[int]], label: np.ndarray, epochs: int = 6, rate: float = 0.3, decay: float = 1e-6, batch: int = 256, seed: int = 7) -> HashedLogistic:
        """Adagrad over shuffled small batches."""
        return self.fit_slots(*self.slots(features), label, epochs, rate, decay, batch, seed)

    def fit_slots(self, flat: np.ndarray, sizes: np.ndarray, label: np.ndarray, epochs: int = 6, rate: float = 0.3, decay: float = 1e-6, batch: int = 256, seed: int = 7) -> HashedLogistic:
        start = np.concatenate(([0], np.cumsum(sizes)))
        square = np.full(1 << self.bits, 1e-3, dtype=np.float32)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(sizes))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                n = sizes[rows]
                pos = np.repeat(start[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                slot, owner = flat[pos], np.repeat(np.arange(len(rows)), n)
                z = np.bincount(owner, weights=self.weight[slot], minlength=len(rows))
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]).astype(np.float32)
                used, where = np.unique(slot, return_inverse=True)
                grad = np.bincount(where, weights=error[owner], minlength=len(used)).astype(np.float32) / len(rows) * 16 + decay * self.weight[used]
                square[used] += grad * grad
                self.weight[used] -= rate * grad / np.sqrt(square[used])
        return self


def merged(slots: np.ndarray, weight: np.ndarray, count: np.ndarray, bits: int = 18) -> HashedLogistic:
    """One regression out of several: each weight is their mean by the examples that have the feature."""
    out = HashedLogistic(bits)
    out.weight[slots] = weight / np.maximum(count, 1)
    return out


class HashedLikelihood(HashedLogistic):
    """Log-likelihood ratio of hashed features between two classes, each feature on its own."""

    def fit(self, features: list[list[int]], label: np.ndarray, alpha: float = 0.3) -> HashedLikelihood:
        flat, sizes = self.slots(features)
        owner = np.repeat(label > 0.5, sizes)
        count = [np.bincount(flat[owner == k], minlength=1 << self.bits) + alpha for k in (False, True)]
        total = [max(int((label > 0.5).sum()), 1), max(int((label <= 0.5).sum()), 1)]
        self.weight = (np.log(count[1] / total[0]) - np.log(count[0] / total[1])).astype(np.float32)
        self.weight[np.bincount(flat, minlength=1 << self.bits) == 0] = 0
        return self
