"""ARIMA with exogenous columns by exact likelihood, walking forward along each series.

The model of a series is y = x b + u, u an ARMA of the series or of its first differences, without trend. Its state space has the
last value (of differenced models) and Harvey's ARMA states; a Kalman filter gives innovations and their variances. A row
without a value, or without all of its exogenous values, is skipped: the state moves on and its variance grows, so gaps need no filling. The
filter is linear, so it runs over y and the columns of x side by side with the same gains, and b and the variance follow in
closed form from the innovations (generalised least squares); only the ARMA coefficients are searched for, by BFGS with
central differences over their unconstrained transforms (stationary and invertible by partial autocorrelations).

All of it is batched: the orders, the origins of refits and the points of a line search or a gradient are rows of one array, so a
series costs a few dozen passes along its rows, however many refits there are. A model's steps don't depend on what else is in
its batch, so later rows change nothing of earlier forecasts.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ORDERS = tuple((p, d, q) for p in (0, 1) for d in (0, 1) for q in (0, 1) if p + d + q)
#: Start values of the first partial autocorrelation of either side. Models with both may have several peaks where the sides nearly
#: cancel or the moving average is nearly at one: of the eight regions (signs, and size of the moving average) so many give a start.
STARTS, REGIONS = (-0.95, -0.6, -0.2, 0.2, 0.6, 0.95), 4
MOST_STEPS = 30
#: A start whose AIC is so far behind the best start of the same rows is not searched from.
HOPELESS = 100.0
#: Partial autocorrelations stay this far from one.
LEAST_GAP = 1e-4


def stationary(u: np.ndarray) -> np.ndarray:
    """(B, p) unconstrained values to the coefficients of stationary autoregressions, by partial autocorrelations."""
    r = (1 - LEAST_GAP) * np.tanh(u)
    out = r.copy()
    for k in range(1, u.shape[1]):
        out[:, :k] = out[:, :k] - r[:, k : k + 1] * out[:, k - 1 :: -1][:, :k]
        out[:, k] = r[:, k]
    return out


@dataclass
class Models:
    """B models: coefficients (B, p) and (B, q), padded by zeros, and differencing (B,)."""

    phi: np.ndarray
    theta: np.ndarray
    d: np.ndarray

    def take(self, rows: np.ndarray) -> Models:
        return Models(self.phi[rows], self.theta[rows], self.d[rows])


@dataclass
class Sums:
    """Of each model: observations counted, sum of log variances, products of innovations over variances (B, c, c)."""

    n: np.ndarray
    logs: np.ndarray
    products: np.ndarray

    def regression(self) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients of the columns beyond the first, log-likelihood): both at their best for given ARMA coefficients."""
        s = self.products
        xx, xy, yy = s[:, 1:, 1:], s[:, 1:, 0], s[:, 0, 0]
        scale = np.maximum(np.trace(xx, axis1=1, axis2=2), 1e-300)[:, None, None] if xx.shape[1] else 1.0
        b = np.linalg.solve(xx / scale + 1e-12 * np.eye(xx.shape[1]), (xy / scale[:, 0] if xx.shape[1] else xy)[:, :, None])[:, :, 0] if xx.shape[1] else xy
        n = np.maximum(self.n, 1)
        variance = np.maximum(yy - (b * xy).sum(1), 1e-300) / n
        return b, -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + self.logs)


def _first_covariance(phi: np.ndarray, shock: np.ndarray) -> np.ndarray:
    """The stationary covariance of the ARMA states, in units of the innovations' variance."""
    size, r = phi.shape
    t = np.zeros((size, r, r))
    t[:, :, 0] = phi
    t[:, np.arange(r - 1), np.arange(1, r)] = 1
    big = np.eye(r * r) - (t[:, :, None, :, None] * t[:, None, :, None, :]).reshape(size, r * r, r * r)
    return np.linalg.solve(big, (shock[:, :, None] * shock[:, None, :]).reshape(size, r * r, 1)).reshape(size, r, r)


def innovations(data: np.ndarray, models: Models, ends: np.ndarray, marks: Sequence[int] = (), states: bool = False):
    """Filters ``data`` (n, c; rows with NaN are skipped) with every model; sums are taken up to each model's row ``ends``.

    With ``marks`` the sums as they stand after each of these rows come instead, one ``Sums`` a mark; with ``states`` also the
    predicted states (n, B, m, c) for the row after each.
    """
    n, c = (len(data) if marks or states else min(len(data), int(ends.max(initial=-1)) + 1)), data.shape[1]
    size = len(models.d)
    r = max(models.phi.shape[1], models.theta.shape[1] + 1)
    phi, shock = np.zeros((size, r)), np.zeros((size, r))
    phi[:, : models.phi.shape[1]], shock[:, 0], shock[:, 1 : models.theta.shape[1] + 1] = models.phi, 1, models.theta
    start, noise = np.zeros((r + 1, r + 1, size)), np.zeros((r + 1, r + 1, size))  # models are the last axis: every step is a few long vectors
    start[1:, 1:] = _first_covariance(phi, shock).transpose(1, 2, 0)
    noise[1:, 1:] = (shock[:, :, None] * shock[:, None, :]).transpose(1, 2, 0)
    d, phi = models.d.astype(float), phi.T[:, None]

    def moved(x: np.ndarray) -> np.ndarray:
        """The transition, applied to the first axis."""
        out = np.empty_like(x)
        out[0] = d * (x[0] + x[1])
        np.multiply(phi, x[1], out=out[1:])
        out[1:-1] += x[2:]
        return out

    there = np.isfinite(data).all(1)
    first = int(np.argmax(there)) if there.any() else n
    a, p = np.zeros((r + 1, c, size)), start
    sums = Sums(np.zeros(size), np.zeros(size), np.zeros((c, c, size)))
    at, kept = {}, np.zeros((n, size, r + 1, c)) if states else None
    for i in range(n):
        if i >= first:
            after = p
            if there[i]:
                zp = d * p[0] + p[1]
                f = np.maximum(d * zp[0] + zp[1], 1e-12)
                gain = zp / f
                after = p - gain[:, None] * zp
                v = data[i][:, None] - (d * a[0] + a[1])
                counts = (i <= ends) & ((models.d == 0) | (i > first))  # the first value of a differenced series is its level
                sums.n, sums.logs = sums.n + counts, sums.logs + counts * np.log(f)
                sums.products = sums.products + (v * (counts / f))[:, None] * v
                a = a + gain[:, None] * v
            a = moved(a)
            p = moved(moved(after).transpose(1, 0, 2)) + noise
            if i == first:
                differenced = models.d == 1
                a[:, :, differenced], p[:, :, differenced] = 0, start[:, :, differenced]
                a[0][:, differenced] = data[i][:, None]
        if states:
            kept[i] = a.transpose(2, 0, 1)
        if i in marks:
            at[i] = Sums(sums.n, sums.logs, sums.products.transpose(2, 0, 1))
    if marks:
        return [at[i] for i in marks]
    sums.products = sums.products.transpose(2, 0, 1)
    return (sums, kept) if states else sums


class _Search:
    """The free values of B models of given orders, and their likelihood on the rows up to ``ends``."""

    def __init__(self, data: np.ndarray, orders: Sequence[tuple[int, int, int]]):
        self.data, self.orders = data, list(orders)
        self.p, self.q = max(o[0] for o in orders), max(o[2] for o in orders)

    def free(self, which: np.ndarray) -> np.ndarray:
        p, q = (np.array([o[k] for o in self.orders])[which] for k in (0, 2))
        return np.hstack([np.arange(self.p) < p[:, None], np.arange(self.q) < q[:, None]])

    def models(self, u: np.ndarray, which: np.ndarray) -> Models:
        return Models(stationary(u[:, : self.p]), -stationary(u[:, self.p :]), np.array([o[1] for o in self.orders])[which])

    def likelihood(self, u: np.ndarray, which: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return innovations(self.data, self.models(u, which), ends).regression()[1]

    def starts(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(free values, order, place in ``ends``) of every start: the most likely points of a grid, by order and signs."""
        grid = []
        for k, (p, _, q) in enumerate(self.orders):
            for a in STARTS if p else (0.0,):
                for b in STARTS if q else (0.0,):
                    u = np.zeros(self.p + self.q)
                    u[: min(self.p, 1)], u[self.p : self.p + min(self.q, 1)] = np.arctanh(a), np.arctanh(b)
                    grid.append((k, (a > 0, b > 0, abs(b) > 0.7) if p and q else (), u))
        which, u = np.array([g[0] for g in grid]), np.array([g[2] for g in grid])
        last = np.full(len(grid), len(self.data))
        seen = np.array([x.regression()[1] for x in innovations(self.data, self.models(u, which), last, list(ends))])
        picked, order, place = [], [], []
        for k in range(len(self.orders)):
            regions = {}
            for row, g in enumerate(grid):
                if g[0] == k:
                    regions.setdefault(g[1], []).append(row)
            tops = np.array([np.array(rows)[seen[:, rows].argmax(1)] for rows in regions.values()])  # regions x ends
            ranked = np.argsort(-np.take_along_axis(seen.T, tops, 0), axis=0)[:REGIONS]
            for rows in np.take_along_axis(tops, ranked, 0):
                picked.append(rows)
                order.append(np.full(len(ends), k))
                place.append(np.arange(len(ends)))
        rows = np.concatenate(picked)
        return u[rows], np.concatenate(order), np.concatenate(place)

    def best(self, u: np.ndarray, which: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(free values, log-likelihood) at the optimum of each model, by BFGS; models that have arrived leave the batch."""
        size, k = u.shape
        free, h = self.free(which), 1e-5
        value, inverse, plain = self.likelihood(u, which, ends), np.tile(np.eye(k), (size, 1, 1)), np.zeros(size, bool)
        live, old, step = np.flatnonzero(free.any(1)), None, None
        if not len(live):
            return u, value
        for _ in range(MOST_STEPS):
            around = self._around(u, which, ends, live, h * np.eye(k)[:, None])
            slope = np.where(free[live], (around - value[live]).T / h, 0.0)
            if old is not None:
                self._update(inverse, live, step, old - slope)
            go = np.abs(slope).max(1) > 1e-3
            live, slope = live[go], slope[go]
            if not len(live):
                break
            way = np.einsum("bij,bj->bi", inverse[live], slope)
            uphill = (way * slope).sum(1) > 0
            way = np.where(uphill[:, None], way, slope)
            inverse[live[~uphill]] = np.eye(k)
            way *= np.minimum(1.0, 1.0 / np.maximum(np.linalg.norm(way, axis=1), 1e-300))[:, None]
            got = self._around(u, which, ends, live, way[None])[0]
            scale = np.ones(len(live))
            short = np.flatnonzero(~(got > value[live] + 0.1 * (way * slope).sum(1)))  # too long a step for these
            if len(short):
                shorter = np.array([0.3, 0.1, 0.02])
                tried = np.vstack([got[short], self._around(u, which, ends, live[short], shorter[:, None, None] * way[short])])
                pick = tried.argmax(0)
                got[short], scale[short] = tried[pick, np.arange(len(short))], np.append(1.0, shorter)[pick]
            gain = got - value[live]
            step, old = np.where(gain > 0, scale, 0.0)[:, None] * way, slope
            u[live] += step
            value[live] += np.maximum(gain, 0.0)
            # without a gain, once more along the slope itself; without one there either, it has arrived
            small = gain < 1e-4
            inverse[live[small]] = np.eye(k)
            stay = ~(small & plain[live])
            plain[live] = small
            live, step, old = live[stay], step[stay], old[stay]
        return u, value

    def _around(self, u: np.ndarray, which: np.ndarray, ends: np.ndarray, rows: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """Likelihoods (moves, rows) at each of several moves from the points of ``rows``."""
        if not len(rows):
            return np.zeros((len(moves), 0))
        at = (u[rows] + moves).reshape(-1, u.shape[1])
        return self.likelihood(at, np.tile(which[rows], len(moves)), np.tile(ends[rows], len(moves))).reshape(len(moves), -1)

    @staticmethod
    def _update(inverse: np.ndarray, rows: np.ndarray, s: np.ndarray, y: np.ndarray) -> None:
        sy = (s * y).sum(1)
        good = sy > 1e-12
        rows, s, y, sy = rows[good], s[good], y[good], sy[good]
        left = np.eye(s.shape[1]) - s[:, :, None] * y[:, None, :] / sy[:, None, None]
        inverse[rows] = left @ inverse[rows] @ left.transpose(0, 2, 1) + s[:, :, None] * s[:, None, :] / sy[:, None, None]


@dataclass
class Fits:
    """For each of several last rows: the order of least AIC, its model, coefficients of the exogenous columns, likelihood and AIC."""

    order: list[tuple[int, int, int]]
    models: Models
    exog: np.ndarray
    likelihood: np.ndarray
    aic: np.ndarray


def fitted(data: np.ndarray, ends: Sequence[int], orders: Sequence[tuple[int, int, int]] = ORDERS, least: int = 10) -> Fits:
    """The best model of the rows up to each of ``ends``; AIC is infinite with fewer than ``least`` innovations."""
    if any(d > 1 or min(p, d, q) < 0 for p, d, q in orders):
        raise ValueError("orders have no negative part and are differenced once at most")
    ends = np.asarray(ends)
    search = _Search(data, orders)
    u, which, place = search.starts(ends)
    value = search.likelihood(u, which, ends[place])
    behind = 2 * (search.free(which).sum(1) - value)
    behind = behind - np.array([behind[place == e].min() for e in range(len(ends))])[place]
    near = np.flatnonzero(behind <= HOPELESS)
    u[near], value[near] = search.best(u[near], which[near], ends[place[near]])
    models = search.models(u, which)
    sums = innovations(data, models, ends[place])
    b, _ = sums.regression()
    aic = np.where(sums.n >= least, -2 * value + 2 * (search.free(which).sum(1) + data.shape[1]), np.inf)
    pick = np.array([np.flatnonzero(place == e)[aic[place == e].argmin()] for e in range(len(ends))])
    return Fits([orders[k] for k in which[pick]], models.take(pick), b[pick], value[pick], aic[pick])


def forecasts(y: np.ndarray, x: np.ndarray, ahead: np.ndarray, orders: Sequence[tuple[int, int, int]], refit_every: int, horizon: int, min_train: int) -> np.ndarray:
    """The forecast ``horizon`` rows ahead of each row; ``ahead`` holds the exogenous values that it takes."""
    out = pd.Series(y).ffill().to_numpy(float).copy()
    scale = np.max(np.abs(np.nan_to_num(x[:min_train])), axis=0, initial=0.0)
    scale = np.where(scale > 0, scale, 1.0)
    data = np.column_stack([y, x / scale])
    there = np.isfinite(data).all(1)
    first = int(np.argmax(there)) if there.any() else len(y)
    ends = np.arange(first + min_train - 1, len(y), refit_every)
    if not len(ends):
        return out
    fits = fitted(data, ends, orders)
    _, states = innovations(data, fits.models, np.full(len(ends), len(y)), states=True)
    rows = np.arange(ends[0], len(y))
    own = (rows - ends[0]) // refit_every
    a, d, phi = states[rows, own], fits.models.d[own][:, None, None], np.zeros((len(rows), states.shape[2] - 1))
    phi[:, : fits.models.phi.shape[1]] = fits.models.phi[own]
    for _ in range(horizon - 1):
        moved = phi[:, :, None] * a[:, 1:2]
        moved[:, :-1] += a[:, 2:]
        a = np.concatenate([d * (a[:, :1] + a[:, 1:2]), moved], axis=1)
    expected = (d * a[:, :1] + a[:, 1:2])[:, 0]
    found = expected[:, 0] + ((ahead[rows] / scale - expected[:, 1:]) * fits.exog[own]).sum(1)
    ok = np.isfinite(found) & np.isfinite(fits.aic[own])
    out[rows[ok]] = found[ok]
    return out


def arima_walk_forward(
    df: DataFrame, keys: Sequence[str], value: str, orders: Sequence[tuple[int, int, int]] = ORDERS, refit_every: int = 13, horizon: int = 1,
    min_train: int = 52, date: str = "date", exog: Sequence[str] = (), future: Sequence[str] | None = None,
) -> DataFrame:
    """(keys, date, prediction): the order of least AIC, refitted every so many rows and only filtered on between.

    Rows are weeks: missing ones belong into the table with a NULL value (``align.weekly_grid``), and are skipped by the filter. With
    exogenous columns, a forecast takes their values at the origin, or those of the columns ``future``, in the order of
    ``exog``, where they are known ahead; where these are NULL, and before ``min_train`` rows, it is the last known value.
    """
    from .learn import nulls, per_series

    orders, columns = tuple(orders), [*exog, *(future or ())]

    def step(pdf):
        x = pdf[list(exog)].to_numpy(float).reshape(len(pdf), len(exog))
        ahead = pdf[list(future)].to_numpy(float) if future else x
        y = pdf[value].to_numpy(float)
        return pd.DataFrame({"prediction": forecasts(y, x, ahead, orders, refit_every, horizon, min_train)})

    return nulls(per_series(df.select(*keys, date, value, *dict.fromkeys(columns)), keys, ["prediction"], step, date), ["prediction"])


def arimax_walk_forward(
    df: DataFrame, keys: Sequence[str], value: str, exog: Sequence[str], horizon: int = 1, min_train: int = 52, refit_every: int = 13,
    date: str = "date", future: Sequence[str] | None = None, orders: Sequence[tuple[int, int, int]] = ((1, 1, 0), (1, 1, 1), (0, 1, 1)),
) -> DataFrame:
    """``arima_walk_forward`` with exogenous columns; their coefficients and the errors' model have one likelihood."""
    return arima_walk_forward(df, keys, value, orders, refit_every, horizon, min_train, date, exog, future)
