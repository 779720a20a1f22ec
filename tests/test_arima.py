"""ARIMA: likelihood against dense covariances, known parameters, gaps, and the grid of conditional squares that it replaced."""
import datetime as dt

import numpy as np
import pytest

from weekloom.operators import learn
from weekloom.operators.arima import ORDERS, Models, fitted, forecasts, innovations, stationary

DAY = dt.date(2020, 1, 6)


def simulated(seed, n=300, phi=0.7, theta=-0.3, d=1):
    rng = np.random.default_rng(seed)
    e, z = rng.standard_normal(n + 100), np.zeros(n + 100)
    for i in range(1, n + 100):
        z[i] = phi * z[i - 1] + e[i] + theta * e[i - 1]
    return np.cumsum(z[100:]) + 50 if d else z[100:]


def dense(y, x, order, phi, theta):
    """The profile likelihood and coefficients from the covariance matrix of all observed values."""
    p, d, q = order
    n, psi = len(y), np.zeros(3000)
    psi[0] = 1
    for k in range(1, len(psi)):
        psi[k] = (phi * psi[k - 1] if p else 0) + (theta if q and k == 1 else 0)
    gamma = np.array([psi[: len(psi) - k] @ psi[k:] for k in range(n)])
    c = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    rows = np.flatnonzero(np.isfinite(y) & np.isfinite(x).all(1))
    if d:
        first, rows = rows[0], rows[1:]
        up = np.array([[1.0 if first < s <= t else 0.0 for s in range(n)] for t in rows])
        v, y, x = up @ c @ up.T, y[rows] - y[first], x[rows] - x[first]
    else:
        v, y, x = c[np.ix_(rows, rows)], y[rows], x[rows]
    w = np.linalg.inv(v)
    b = np.linalg.solve(x.T @ w @ x, x.T @ w @ y) if x.shape[1] else np.zeros(0)
    r = y - x @ b
    return b, -0.5 * (len(y) * (np.log(2 * np.pi * (r @ w @ r) / len(y)) + 1) + np.linalg.slogdet(v)[1])


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("columns", [0, 2])
def test_likelihood_equals_dense_gaussian(order, columns):
    rng = np.random.default_rng(1)
    y, x = simulated(2, 90), rng.standard_normal((90, 2))[:, :columns]
    y[[0, 1, 7, 8, 50]] = np.nan
    if columns:
        x[30, 1] = np.nan
    m = Models(np.array([[0.6 if order[0] else 0.0]]), np.array([[-0.4 if order[2] else 0.0]]), np.array([order[1]]))
    b, value = innovations(np.column_stack([y, x]), m, np.array([89])).regression()
    own_b, own = dense(y, x, order, 0.6, -0.4)
    assert value[0] == pytest.approx(own, abs=1e-6)
    assert b[0] == pytest.approx(own_b, abs=1e-6)


def test_transforms_are_stationary():
    for u in np.random.default_rng(0).standard_normal((200, 3)) * 3:
        phi = stationary(u[None])[0]
        assert np.abs(np.roots([1, *-phi])).max() < 1


def test_known_parameters_are_recovered():
    found = np.array([[*f.models.phi[0], *f.models.theta[0]] for f in (fitted(simulated(s, 1000)[:, None], [999], [(1, 1, 1)]) for s in range(12))])
    assert np.abs(found.mean(0) - [0.7, -0.3]).max() < 0.03 and np.abs(found - [0.7, -0.3]).max() < 0.2
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 2)).cumsum(0)
    y = simulated(5, 400) + x @ [2.0, -1.0]
    y[100:140] = np.nan
    assert fitted(np.column_stack([y, x]), [399], [(1, 1, 1)]).exog[0] == pytest.approx([2.0, -1.0], abs=0.2)


def grid_parameters(z, p, q):
    """Least conditional squares on 39 values of theta, as before."""
    thetas = np.linspace(-0.95, 0.95, 39) if q else np.zeros(1)
    a, b = np.zeros((len(z), len(thetas))), np.zeros((len(z), len(thetas)))
    for t in range(1, len(z)):
        a[t], b[t] = z[t] - thetas * a[t - 1], z[t - 1] - thetas * b[t - 1]
    phi = np.clip((a * b).sum(0) / np.maximum((b * b).sum(0), 1e-300), -0.999, 0.999) if p else np.zeros(len(thetas))
    k = int(((a - phi * b) ** 2).sum(0).argmin())
    return phi[k], thetas[k]


def test_beats_the_grids_likelihood_on_every_series():
    rng = np.random.default_rng(9)
    for s in range(100):
        y = simulated(s, 120, rng.uniform(-0.9, 0.9), rng.uniform(-0.9, 0.9), s % 2)
        order = ((1, 1, 1), (1, 0, 1), (0, 1, 1))[s % 3]
        phi, theta = grid_parameters(np.diff(y) if order[1] else y, order[0], order[2])
        old = innovations(y[:, None], Models(np.array([[phi]]), np.array([[theta]]), np.array([order[1]])), np.array([119])).regression()[1][0]
        assert fitted(y[:, None], [119], [order]).likelihood[0] > old - 1e-3


def test_forecasts_over_gaps():
    """Of the state space: equal to a filter that is told nothing of the gap, and steps ahead shrink towards the mean of an AR(1)."""
    y = simulated(4, 200, 0.8, 0.0, 0)
    y[150:155] = np.nan
    none = np.zeros((200, 0))
    one = forecasts(y, none, none, [(1, 0, 0)], 200, 1, 140)
    phi = fitted(y[:, None], [139], [(1, 0, 0)]).models.phi[0, 0]
    assert one[149] == pytest.approx(phi * y[149]) and one[154] == pytest.approx(phi**6 * y[149]) and one[160] == pytest.approx(phi * y[160])
    three = forecasts(y, none, none, [(1, 0, 0)], 200, 3, 140)
    assert three[160] == pytest.approx(phi**3 * y[160])
    walk = forecasts(np.where(np.arange(200) == 180, np.nan, np.arange(200.0)), none, none, [(0, 1, 0)], 50, 2, 60)
    assert walk[180] == pytest.approx(179.0) and list(walk[:59]) == list(np.arange(59.0))


def test_walk_forward_is_causal_and_beats_persistence(spark):
    y = simulated(1, 260, 0.6, 0.0, 0)
    rows = [(k, DAY + dt.timedelta(weeks=t), None if t in (70, 71) else float(v)) for k in (1, None) for t, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k int, date date, v double")
    run = lambda x, **o: {(r["k"], r["date"]): r["prediction"] for r in learn.arima_walk_forward(x, ["k"], "v", **o).collect()}
    got = run(df)
    cut = DAY + dt.timedelta(weeks=150)
    assert {k: v for k, v in run(df.filter(df.date < cut)).items()} == pytest.approx({k: v for k, v in got.items() if k[1] < cut}, abs=1e-3)
    own = np.array([got[1, DAY + dt.timedelta(weeks=t)] for t in range(260)])
    assert np.abs(own[80:-1] - y[81:]).mean() < 0.95 * np.abs(y[80:-1] - y[81:]).mean()
    assert list(own[:10]) == pytest.approx(list(y[:10])) and own[71] == own[71]
    assert learn.arima_walk_forward(df.limit(0), ["k"], "v").collect() == []
    assert set(run(df.selectExpr("k", "date", "cast(null as double) AS v")).values()) == {None}
    with pytest.raises(Exception, match="differenced once"):
        learn.arima_walk_forward(df, ["k"], "v", [(1, 2, 0)]).collect()
