"""Kernel recursive least squares on a sparse dictionary: every step costs the square of the dictionary, never its cube.

The function is given by its values b at the dictionary's points; a point x sees them by its projection a = K^-1 k(x), where K is
the kernel matrix of the dictionary (approximate linear dependence: 1 - k'a is what the dictionary can't express of x). So a
row is a linear observation y = a'b, and recursive least squares keeps P = (sum of a a' + ridge K^-1)^-1 and b: ridge weighs the
squared norm of the function, b'K^-1 b, against the squared errors.

* A row near the span of the dictionary updates P and b by rank one.
* A novel row becomes an entry: K^-1 grows by its border, b by what the function says there, P by what that leaves open; then the row
  is learned as any other. Rows so far don't see the new point.
* An entry is removed by projecting it on the others, c = (.., -g, 1) with g = K_rest^-1 k: b is constrained to c'b = 0, a rank-one step
  of P, and K^-1 loses its border. Rows seen before are then projections on what is left.

So at any time b is the penalised least-squares solution over all rows, each by its projection.
"""
from __future__ import annotations

import numpy as np

#: Added to the diagonal of K, so that nearly equal entries do no harm.
JITTER = 1e-6


class KernelLeastSquares:
    """One regression. ``scale`` multiplies features before distances are taken; ``forget`` below one lets old rows fade."""

    def __init__(self, size: int, width: float, ridge: float, novelty: float, most: int, offset: float = 0.0, scale: np.ndarray | None = None, forget: float = 1.0):
        self.width, self.ridge, self.novelty, self.most, self.forget = width, ridge, novelty, most, forget
        self.offset, self.scale = offset, np.ones(size) if scale is None else scale.copy()
        self.entries, self.used = np.empty((0, size)), np.empty(0)
        self.inverse, self.p, self.b = np.empty((0, 0)), np.empty((0, 0)), np.empty(0)

    def __len__(self) -> int:
        return len(self.b)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        gap = (self.entries - x) * self.scale
        return np.exp(np.einsum("ij,ij->i", gap, gap) / (-2 * self.width**2))

    def predict(self, x: np.ndarray) -> tuple[float, float]:
        """(value, the largest kernel value of an entry)."""
        if not len(self):
            return self.offset, 0.0
        k = self.kernel(x)
        return self.offset + float(k @ self.inverse @ self.b), float(k.max())

    def _project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        k = self.kernel(x)
        a = self.inverse @ k
        return k, a, float(1 + JITTER - k @ a)

    def learn(self, x: np.ndarray, y: float, weight: float = 1.0, grow: bool = True) -> str:
        """Learns a row; says whether it was inserted, replaced an entry or updated the values."""
        y, action = y - self.offset, "inserted"
        k, a, rest = self._project(x)
        if not grow or (len(self) and rest <= self.novelty):
            if not len(self):
                return "updated"
            self._update(a, y, weight)
            self.used[int(k.argmax())] += 1
            return "updated"
        if len(self) >= self.most:
            self.remove(int(self.used.argmin()))
            k, a, rest = self._project(x)
            action = "replaced"
        self._insert(x, a, rest)
        self._update(np.append(np.zeros(len(self) - 1), 1.0), y, weight)
        return action

    def _update(self, a: np.ndarray, y: float, weight: float) -> None:
        seen = self.p @ a
        gain = seen / (self.forget / weight + a @ seen)
        self.b = self.b + gain * (y - a @ self.b)
        self.p = (self.p - gain[:, None] * seen) / self.forget

    def _insert(self, x: np.ndarray, a: np.ndarray, rest: float) -> None:
        n, rest = len(self), max(rest, JITTER)
        inverse, p, seen = np.empty((n + 1, n + 1)), np.empty((n + 1, n + 1)), self.p @ a
        inverse[:n, :n] = self.inverse + a[:, None] * a / rest
        inverse[n, :n] = inverse[:n, n] = -a / rest
        inverse[n, n] = 1 / rest
        p[:n, :n], p[n, n] = self.p, a @ seen + rest / self.ridge
        p[n, :n] = p[:n, n] = seen
        self.inverse, self.p, self.b = inverse, p, np.append(self.b, a @ self.b)
        self.entries = np.vstack([self.entries, x])
        self.used = np.append(self.used, self.used.min(initial=0.0) + 1)  # a new entry isn't the next to go

    def remove(self, j: int) -> None:
        """Takes an entry away; what it said is projected on the others."""
        keep = np.arange(len(self)) != j
        border = self.inverse[keep, j] / self.inverse[j, j]  # -g, by the inverse of a bordered matrix
        c = np.zeros(len(self))
        c[keep], c[j] = border, 1.0
        seen = self.p @ c
        self.b = (self.b - seen * (c @ self.b) / (c @ seen))[keep]
        self.p = (self.p - seen[:, None] * seen / (c @ seen))[np.ix_(keep, keep)]
        self.inverse = self.inverse[np.ix_(keep, keep)] - self.inverse[j, j] * border[:, None] * border
        self.entries, self.used = self.entries[keep], self.used[keep]

    def rescale(self, scale: np.ndarray, width: float | None = None) -> None:
        """Takes other scales or another width; the values at the entries stay, but entries that are no longer novel go. Costs the cube
        of the dictionary."""
        self.scale, self.width = scale.copy(), width or self.width
        if len(self):
            z = self.entries * self.scale
            gaps = ((z[:, None] - z[None]) ** 2).sum(2)
            self.inverse = np.linalg.inv(np.exp(gaps / (-2 * self.width**2)) + JITTER * np.eye(len(self)))
            # entries that the others express by now
            while len(self) > 1 and 1 / np.diag(self.inverse).max() <= self.novelty:
                self.remove(int(np.diag(self.inverse).argmax()))

    def absorb(self, other: KernelLeastSquares) -> None:
        """Learns the other's values at its entries, each weighing as many rows as its variance stands for beyond the penalty, which
        had drawn it to the other's offset."""
        weights = np.maximum(1 / np.maximum(np.diag(other.p), 1e-12) - other.ridge, 0.5)
        values = other.offset + other.b * (weights + other.ridge) / weights
        for x, y, weight in zip(other.entries, values, weights, strict=True):
            self.learn(x, float(y), float(weight), grow=len(self) < self.most)
