"""The recursion against a batch solution over all rows, with and without entries taken away."""
import time

import numpy as np
import pytest

from weekloom.operators import learn
from weekloom.operators.krls import JITTER, KernelLeastSquares


class Batch:
    """The same regression, solved anew from all rows' projections at every step."""

    def __init__(self, width, ridge):
        self.width, self.ridge, self.rows, self.y = width, ridge, np.empty((0, 0)), np.empty(0)

    def gram(self, points):
        gaps = ((points[:, None] - points[None]) ** 2).sum(2)
        return np.exp(gaps / (-2 * self.width**2)) + JITTER * np.eye(len(points))

    def follow(self, before, after, x, y):
        """``before`` and ``after``: the entries around the step that has learned x, y."""
        gone = [j for j, e in enumerate(before) if not (after == e).all(1).any()]
        for j in gone:
            keep = np.arange(len(before)) != j
            k = self.gram(before)
            g = np.linalg.solve(k[np.ix_(keep, keep)], k[keep, j])
            self.rows = self.rows[:, keep] + self.rows[:, [j]] * g
            before = before[keep]
        self.rows = np.hstack([self.rows, np.zeros((len(self.rows), len(after) - len(before)))])
        if len(after) > len(before):
            a = np.eye(len(after))[-1]
        else:
            k = np.exp(((after - x) ** 2).sum(1) / (-2 * self.width**2))
            a = np.linalg.solve(self.gram(after), k)
        self.rows, self.y = np.vstack([self.rows, a]), np.append(self.y, y)
        return np.linalg.solve(self.rows.T @ self.rows + self.ridge * np.linalg.inv(self.gram(after)), self.rows.T @ self.y)


@pytest.mark.parametrize("most", [200, 12])
def test_equals_batch_along_a_thousand_rows(most):
    rng = np.random.default_rng(1)
    model, batch, seen = KernelLeastSquares(2, 0.7, 0.1, 0.05, most, 1.5), Batch(0.7, 0.1), set()
    for t in range(1000):
        x = rng.uniform(-2, 2, 2)
        y = np.sin(2 * x[0]) * x[1] + 0.1 * rng.standard_normal()
        before = model.entries.copy()
        seen.add(model.learn(x, y + 1.5))
        b = batch.follow(before, model.entries, x, y)
        if t % 50 == 49:
            assert np.abs(model.b - b).max() < 1e-6
    assert seen == ({"inserted", "updated"} if most == 200 else {"inserted", "updated", "replaced"}) and len(model) <= most
    assert model.inverse == pytest.approx(np.linalg.inv(batch.gram(model.entries)), rel=1e-5, abs=1e-5)


def test_a_row_costs_no_cube():
    def seconds(most):
        rng = np.random.default_rng(0)
        model = KernelLeastSquares(3, 0.3, 0.1, 1e-3, most)
        for _ in range(2 * most):
            model.learn(rng.uniform(-2, 2, 3), 1.0)
        began = time.process_time()
        for _ in range(200):
            model.learn(rng.uniform(-2, 2, 3), 1.0)
        return time.process_time() - began

    assert seconds(400) < 40 * seconds(100) + 0.2


def test_forgetting_and_rescaling():
    model, steady = (KernelLeastSquares(1, 1.0, 0.1, 0.1, 20, forget=f) for f in (0.9, 1.0))
    for m in (model, steady):
        for y in [1.0] * 50 + [3.0] * 50:
            m.learn(np.array([0.0]), y)
    assert model.predict(np.zeros(1))[0] == pytest.approx(3, abs=0.05) and steady.predict(np.zeros(1))[0] == pytest.approx(2, abs=0.05)
    before = steady.predict(np.zeros(1))[0]
    steady.rescale(np.array([2.0]))
    assert steady.predict(np.zeros(1))[0] == pytest.approx(before, abs=1e-4)


def test_absorbing_keeps_what_both_know():
    rng = np.random.default_rng(2)
    left, right = (KernelLeastSquares(1, 0.5, 0.01, 0.05, 40) for _ in range(2))
    for _ in range(200):
        a, b = rng.uniform(-3, 0, 1), rng.uniform(0, 3, 1)
        left.learn(a, float(np.sin(a[0])))
        right.learn(b, float(np.sin(b[0])))
    left.absorb(right)
    x = np.linspace(-2.8, 2.8, 50)
    assert np.abs([left.predict(np.array([v]))[0] - np.sin(v) for v in x]).max() < 0.1


def test_error_on_a_fast_curve():
    errors = []
    for seed in (5, 6):
        r = np.random.default_rng(seed)
        x = r.uniform(-2, 2, (300, 1))
        y = np.sin(2 * x[:, 0])
        p = learn.learned(x, y, np.arange(300), learn.RuleLearner(1, width=0.5, novelty=0.01, ridge_=0.01))["prediction"].to_numpy()
        errors.append(np.abs(p - y)[150:].mean())
    assert max(errors) < 0.04
