"""Forecasts that learn along each series. Spark groups by series; small numpy steps run within one.

A weekly series has some hundred rows, so a group is small however many series there are. A label counts as known at an
origin once its target date is at or before it. Rows that miss a value are predicted as NULL and never learned from.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.sources.scratch import new_folder

from .align import MOST_FOLDS, by_date
from .arima import arima_walk_forward, arimax_walk_forward  # noqa: F401
from .features import past
from .krls import KernelLeastSquares
from .ranks import with_quantiles

Fit = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]


def per_series(df: DataFrame, keys: Sequence[str], out: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], date: str = "date", texts: Sequence[str] = ()) -> DataFrame:
    """Runs a step on each series in order of time; it returns the keys, the date, the named doubles and then the named texts."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [*keys, date]), *(f"`{c}` double" for c in out), *(f"`{c}` string" for c in texts)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable").reset_index(drop=True)
        got = step(pdf)
        return pd.concat([pdf[[*keys, date]], got[[*out, *texts]]], axis=1)

    return dealt(df, keys).applyInPandas(run, schema)


def dealt(df: DataFrame, keys: Sequence[str]) -> GroupedData:
    """Groups by series, dealt to all shuffle partitions: series are small in bytes but long to compute, so adaptive merging by
    size would put them all into a few tasks. They are dealt by a hash of the keys that leads the grouping: on the keys themselves
    Spark would drop the repartition as one that the data has already, and merge partitions after all."""
    if not keys:
        return df.groupBy()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_deal", F.xxhash64(*keys)).repartition(n, "_deal").groupBy("_deal", *keys)


def known_before(dates: pd.Series, targets: pd.Series) -> np.ndarray:
    """For each origin, how many leading rows have an observed target."""
    d, t = pd.to_datetime(dates).to_numpy(), pd.to_datetime(targets).to_numpy()
    return np.searchsorted(np.maximum.accumulate(t), d, side="right")


def ridge(alpha: float = 1.0) -> Fit:
    """Standardised ridge regression; columns that don't vary are left out."""

    def fit(x, y):
        m, s = x.mean(0), x.std(0)
        s = np.where(s > 0, s, np.inf)
        z = (x - m) / s
        b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
        return lambda q: (q - m) / s @ b + y.mean()

    return fit


def huber(delta: float = 1.345, rounds: int = 30) -> Fit:
    """Least squares with Huber weights, reweighted until settled: the error-correction regression."""

    def fit(x, y):
        a = np.column_stack([np.ones(len(x)), x])
        w = np.ones(len(a))
        b = np.zeros(a.shape[1])
        for _ in range(rounds):
            sw = np.sqrt(w)[:, None]
            new = np.linalg.lstsq(a * sw, y * sw[:, 0], rcond=None)[0]
            r = np.abs(y - a @ new)
            scale = np.median(r) / 0.6745
            w = np.minimum(1.0, delta * scale / np.maximum(r, 1e-12)) if scale > 0 else np.ones(len(a))
            done, b = np.allclose(new, b, rtol=1e-8, atol=1e-10), new
            if done:
                break
        return lambda q: np.column_stack([np.ones(len(q)), q]) @ b

    return fit


def walk_forward(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, fit: Fit, min_train: int = 52, refit_every: int = 13, date: str = "date", target_date: str = "target_date", ahead: Sequence[str] | None = None) -> DataFrame:
    """(keys, date, prediction, trained): at each origin a model of all labels known then, refitted every so many origins.

    ``ahead`` names the columns that a forecast takes in the place of the features, such as their known future values.
    """

    def step(pdf):
        x, y = pdf[list(features)].to_numpy(float), pdf[target].to_numpy(float)
        asked = pdf[list(ahead)].to_numpy(float) if ahead else x
        whole, known = np.isfinite(x).all(1), known_before(pdf[date], pdf[target_date])
        out, trained, model, since = np.full(len(x), np.nan), np.full(len(x), np.nan), None, refit_every
        for i in range(len(x)):
            rows = np.flatnonzero(whole[: known[i]] & np.isfinite(y[: known[i]]))
            if len(rows) >= min_train and since >= refit_every:
                model, since, size = fit(x[rows], y[rows]), 0, len(rows)
            since += 1
            if model and np.isfinite(asked[i]).all():
                out[i], trained[i] = model(asked[i : i + 1])[0], size
        return pd.DataFrame({"prediction": out, "trained": trained})

    return nulls(per_series(df, keys, ["prediction", "trained"], step, date), ["prediction", "trained"])


def origins(df: DataFrame, keys: Sequence[str], min_train: int, horizon: int, date: str = "date") -> DataFrame:
    """(keys, origin, date, target_date): the rows of each series, counted from 0, from which a walk-forward predicts ``horizon`` rows ahead,
    after ``min_train`` rows and as long as the target is there."""
    w = by_date(keys, date)
    x = df.select(*keys, (F.row_number().over(w) - 1).alias("origin"), date, F.lead(date, horizon).over(w).alias("target_date"))
    return x.filter((F.col("origin") >= min_train - 1) & F.col("target_date").isNotNull())


def nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def ecm_walk_forward(df: DataFrame, keys: Sequence[str], features: Sequence[str], change: str, origin: str, most_sigmas: float = 8.0, min_train: int = 52, refit_every: int = 13, date: str = "date", drivers: Sequence[str] = ()) -> DataFrame:
    """Origin plus the predicted change of the robust regression; falls back to the origin where features are missing or the
    predicted change is implausible against the earlier changes' deviation.

    With ``drivers`` (columns known at the origin) also sigma, lower and upper: the deviation that past errors show for such drivers, and the
    quantiles of past errors over it (see ``conditional_interval``).
    """
    p = walk_forward(df, keys, features, change, huber(), min_train, refit_every, date).withColumnRenamed("prediction", "_c").drop("trained")
    x = df.join(p, [*keys, date])
    sd = past(F.stddev_samp, "_moved", keys, 12, date)
    x = x.withColumn("_moved", F.col(origin) - F.lag(origin, 1).over(by_date(keys, date)))
    bad = F.col("_c").isNull() | F.coalesce(F.abs("_c") > most_sigmas * sd, F.lit(False))
    out = x.withColumn("fallback", bad).withColumn("prediction", F.col(origin) + F.when(F.col("fallback"), 0.0).otherwise(F.col("_c"))).drop("_c", "_moved")
    if not drivers:
        return out
    band = conditional_interval(out.withColumn("_a", F.col(origin) + F.col(change)), keys, "_a", "prediction", drivers, date=date)
    return out.join(band, [*keys, date])


class Conformal:
    """A band whose level follows its misses: after each row, level += gamma * (alpha - missed), kept within the bounds.

    Residuals are signed and, with ``normalise``, divided by the row's scale; the band runs between their quantiles at level / 2 and
    1 - level / 2, times the scale. Until there are enough of them it is Gaussian, with the scale as deviation. ``seed`` loads
    residuals of earlier rows, which count as no misses.
    """

    def __init__(self, alpha: float = 0.2, gamma: float = 0.02, window: int = 156, at_least: int = 20, bounds=(0.01, 0.60), normalise: bool = True):
        self.alpha, self.gamma, self.window, self.at_least, self.bounds, self.normalise = alpha, gamma, window, at_least, bounds, normalise
        self.level, self.clips, self.errors = min(max(alpha, bounds[0]), bounds[1]), 0, []

    def seed(self, residuals) -> None:
        self.errors = [*self.errors, *(float(r) for r in residuals if np.isfinite(r))][-self.window :]

    @property
    def warm(self) -> bool:
        return len(self.errors) >= self.at_least

    def band(self, point: float, scale: float = 1.0) -> tuple[float, float]:
        scale = abs(scale) or 1.0
        if not (np.isfinite(point) and np.isfinite(scale)):
            return np.nan, np.nan
        if not self.warm:
            w = NormalDist().inv_cdf(1 - self.level / 2) * scale
            return point - w, point + w
        low, high = np.quantile(self.errors, [self.level / 2, 1 - self.level / 2]) * (scale if self.normalise else 1.0)
        return point + low, point + high

    def learn(self, actual: float, point: float, scale: float = 1.0) -> None:
        lower, upper = self.band(point, scale)
        if not (np.isfinite(actual) and np.isfinite(lower)):
            return
        raw = self.level + self.gamma * (self.alpha - float(not lower <= actual <= upper))
        self.level = min(max(raw, self.bounds[0]), self.bounds[1])
        self.clips += raw != self.level
        self.errors = [*self.errors, (actual - point) / ((abs(scale) or 1.0) if self.normalise else 1.0)][-self.window :]


def adaptive_conformal(df: DataFrame, keys: Sequence[str], actual: str, yhat: str, scale: str | None = None, date: str = "date", **options) -> DataFrame:
    """(keys, date, lower, upper, level, clipped, warm) of ``Conformal``; ``clipped`` counts how often the level was kept within its bounds,
    ``warm`` is 1 once the band rests on residuals. Rows must be one step ahead; ``scale`` is a column, 1 by default."""

    def step(pdf):
        c, out = Conformal(**options), []
        sizes = pdf[scale].to_numpy(float) if scale else np.ones(len(pdf))
        for y, h, s in zip(pdf[actual].to_numpy(float), pdf[yhat].to_numpy(float), sizes):
            out.append((*c.band(h, s), c.level, float(c.clips), float(c.warm)))
            c.learn(y, h, s)
        return pd.DataFrame(out, columns=["lower", "upper", "level", "clipped", "warm"])

    return nulls(per_series(df, keys, ["lower", "upper", "level", "clipped", "warm"], step, date), ["lower", "upper"])


def page_hinkley(df: DataFrame, keys: Sequence[str], value: str, delta: float = 0.005, threshold: float = 50.0, date: str = "date") -> DataFrame:
    """(keys, date, path, changed): cumulated rise over the running mean less its minimum; reset after a change. NULLs are skipped."""

    def step(pdf):
        path, hit, n, mean, s, low = [], [], 0, 0.0, 0.0, 0.0
        for v in pdf[value].to_numpy(float):
            if np.isfinite(v):
                n += 1
                mean += (v - mean) / n
                s += v - mean - delta
                low = min(low, s)
            path.append(s - low)
            hit.append(float(s - low > threshold))
            if s - low > threshold:
                n, mean, s, low = 0, 0.0, 0.0, 0.0
        return pd.DataFrame({"path": path, "changed": hit})

    return per_series(df, keys, ["path", "changed"], step, date)


def conditional_interval(df: DataFrame, keys: Sequence[str], actual: str, yhat: str, drivers: Sequence[str], nominal: float = 0.8, at_least: int = 52, date: str = "date") -> DataFrame:
    """(keys, date, sigma, lower, upper): sigma is fitted to past |residuals| on the drivers, floored at a tenth of their mean; the
    band takes the quantiles of past residuals over their sigma."""
    tail = (1 - nominal) / 2

    def step(pdf):
        y, h = pdf[actual].to_numpy(float), pdf[yhat].to_numpy(float)
        a = np.column_stack([np.ones(len(pdf)), pdf[list(drivers)].to_numpy(float)])
        whole = np.isfinite(a).all(1)
        r = y - h
        out = np.full((3, len(y)), np.nan)
        for i in np.flatnonzero(whole & np.isfinite(h)):
            rows = np.flatnonzero(whole[:i] & np.isfinite(r[:i]))
            if len(rows) < at_least:
                continue
            size = np.abs(r[rows])
            c = np.linalg.lstsq(a[rows], size, rcond=None)[0]
            floor = max(0.1 * size.mean(), 1e-12)
            s = max(a[i] @ c, floor)
            z = np.quantile(r[rows] / np.maximum(a[rows] @ c, floor), [tail, 1 - tail])
            out[:, i] = s, h[i] + s * z[0], h[i] + s * z[1]
        return pd.DataFrame({"sigma": out[0], "lower": out[1], "upper": out[2]})

    return nulls(per_series(df, keys, ["sigma", "lower", "upper"], step, date), ["sigma", "lower", "upper"])


class Rule:
    """One rule: a centre, its arousal, the rows that it has learned and its kernel regression."""

    def __init__(self, q: np.ndarray, model: KernelLeastSquares):
        self.centre, self.arousal, self.n, self.model = q.copy(), 0.0, 0, model


class RuleLearner:
    """Evolving rules by participatory learning, each with a sparse kernel regression; one row at a time.

    A row is compatible with a rule by exp(-d**2 / (2 radius**2)), d being its distance to the centre; features are
    standardised by running moments. The arousal of each rule follows 1 - compatibility at the rate beta. If even the least aroused
    rule is above beta, the row opens a rule, while there are fewer than ``most_rules``; else the most compatible
    one learns it and moves its centre towards it by step * compatibility ** (1 - arousal). Two rules that are more compatible than
    1 - beta become one. All this uses the beta of the row before; then beta is divided by ``grow`` if the error was more than
    ``tolerance`` deviations of the target, else multiplied by ``shrink``. ``steady`` keeps it fixed.

    A rule's regression is recursive (``krls``): a row enters its dictionary when the kernel's residual on it exceeds ``novelty``; a full
    dictionary first gives up its least used entry; all other rows update it. Two rules become one by learning the values at the
    smaller one's entries. Distances in a regression use the features' deviations of its start; when these have changed by a tenth
    it is laid out anew. ``forget`` below one lets old rows fade.

    Forecasts are averaged by compatibility, the rows that a rule has learned, and its best kernel value at the point: a rule that
    has seen little, or nothing near, says little. ``action`` says what the last row did: created, inserted, replaced or
    updated, with +merged.
    """

    def __init__(self, size: int, width: float = 1.0, novelty: float = 0.1, most: int = 50, ridge_: float = 0.1, radius: float = 2.5, beta: float = 0.18, grow: float = 0.97, shrink: float = 0.84, tolerance: float = 0.1, bounds: tuple[float, float] = (0.05, 0.5), steady: bool = False, step: float = 0.01, most_rules: int = 20, forget: float = 1.0):
        if not (0 < bounds[0] <= beta <= bounds[1] < 1 and 0 < grow < 1 and 0 < shrink < 1 and 0 < forget <= 1):
            raise ValueError("beta lies within its bounds in (0, 1); grow and shrink lie in (0, 1), forget in (0, 1]")
        if min(width, ridge_, radius) <= 0 or min(most, most_rules) < 1:
            raise ValueError("width, ridge and radius are positive; a dictionary and the rules have room for one")
        self.width, self.novelty, self.most, self.ridge, self.radius = width, novelty, most, ridge_, radius
        self.beta, self.grow, self.shrink, self.tolerance, self.bounds, self.steady = beta, grow, shrink, tolerance, bounds, steady
        self.step, self.most_rules, self.forget = step, most_rules, forget
        self.n, self.mean, self.var, self.unit, self.rules, self.action = 0, np.zeros(size), np.zeros(size), np.ones(size), [], None
        self.y_mean = self.y_var = 0.0

    def _close(self, q: np.ndarray) -> np.ndarray:
        gap = (np.array([r.centre for r in self.rules]) - q) * self.unit
        return np.exp(np.einsum("ij,ij->i", gap, gap) / (-2 * self.radius**2))

    def _moments(self, q: np.ndarray, y: float) -> None:
        self.n += 1
        gap, gap_y = q - self.mean, y - self.y_mean
        self.mean, self.y_mean = self.mean + gap / self.n, self.y_mean + gap_y / self.n
        self.var, self.y_var = self.var + gap * (q - self.mean), self.y_var + gap_y * (y - self.y_mean)
        self.unit = 1 / np.sqrt(np.maximum(self.var / self.n, 1e-12))

    def _take(self, r: Rule, q: np.ndarray, y: float) -> str:
        r.n += 1
        if np.abs(np.log(self.unit / r.model.scale)).max(initial=0.0) > 0.1:
            r.model.rescale(self.unit)
        return r.model.learn(q, y)

    def _merged(self, beta: float) -> bool:
        """Joins the two closest rules, as long as they are more compatible than 1 - beta."""
        some = False
        while len(self.rules) > 1:
            c = np.array([r.centre for r in self.rules]) * self.unit
            pair = np.triu(np.exp(((c[:, None] - c[None]) ** 2).sum(2) / (-2 * self.radius**2)), 1)
            i, j = np.unravel_index(pair.argmax(), pair.shape)
            if pair[i, j] <= 1 - beta:
                break
            big, small = sorted((self.rules[i], self.rules[j]), key=lambda r: -r.n)
            share = big.n / (big.n + small.n)
            big.centre, big.arousal = share * big.centre + (1 - share) * small.centre, share * big.arousal + (1 - share) * small.arousal
            big.n += small.n
            big.model.absorb(small.model)
            self.rules = [r for r in self.rules if r is not small]
            some = True
        return some

    def learn(self, q: np.ndarray, y: float) -> None:
        guess, beta = self.predict(q), self.beta
        self._moments(q, y)
        own = None
        if self.rules:
            if not self.steady:
                far = abs(y - guess) > self.tolerance * np.sqrt(self.y_var / self.n)
                self.beta = min(max(beta / self.grow if far else beta * self.shrink, self.bounds[0]), self.bounds[1])
            close = self._close(q)
            for r, c in zip(self.rules, close, strict=True):
                r.arousal += beta * (1 - c - r.arousal)
            # the first moments are too rough to tell rules apart
            if self.n <= 10 or len(self.rules) >= self.most_rules or min(r.arousal for r in self.rules) <= beta:
                own, c = self.rules[close.argmax()], close.max()
                own.centre = own.centre + self.step * c ** (1 - own.arousal) * (q - own.centre)
        if own is None:
            own = Rule(q, KernelLeastSquares(len(q), self.width, self.ridge, self.novelty, self.most, self.y_mean, self.unit, self.forget))
            self.rules.append(own)
            self._take(own, q, y)
            self.action = "created"
        else:
            self.action = self._take(own, q, y)
        if self._merged(beta):
            self.action += "+merged"

    def predict(self, x: np.ndarray) -> float:
        if not self.rules:
            return np.nan
        f, near = np.array([r.model.predict(x) for r in self.rules]).T
        w = self._close(x) * near * [r.n for r in self.rules] + 1e-12
        return float(w @ f / w.sum())


def learned(x: np.ndarray, y: np.ndarray, known: np.ndarray, model: RuleLearner) -> pd.DataFrame:
    """Predictions of all rows in order; before each, the model learns the labels that have become known. ``action`` is that of
    the last one learned since the row before, None if there was none."""
    whole, done = np.isfinite(x).all(1), 0
    out, nr, nd, beta = (np.full(len(x), np.nan) for _ in range(4))
    action = np.full(len(x), None, object)
    for i in range(len(x)):
        while done < known[i]:
            if whole[done] and np.isfinite(y[done]):
                model.learn(x[done], y[done])
                action[i] = model.action
            done += 1
        nr[i], nd[i], beta[i] = len(model.rules), sum(len(r.model) for r in model.rules), model.beta
        if whole[i]:
            out[i] = model.predict(x[i])
    return pd.DataFrame({"prediction": out, "rules": nr, "dictionary": nd, "beta": beta, "action": action})


def online_learner(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, width: float = 1.0, novelty: float = 0.1, most: int = 50, ridge_: float = 0.1, radius: float = 2.5, date: str = "date", target_date: str = "target_date", **more) -> DataFrame:
    """(keys, date, prediction, rules, dictionary, beta, action) of a ``RuleLearner`` along each series, ``more`` being its other
    options. Labels arrive delayed."""

    def step(pdf):
        x, y = pdf[list(features)].to_numpy(float), pdf[target].to_numpy(float)
        return learned(x, y, known_before(pdf[date], pdf[target_date]), RuleLearner(x.shape[1], width, novelty, most, ridge_, radius, **more))

    return nulls(per_series(df, keys, ["prediction", "rules", "dictionary", "beta"], step, date, ["action"]), ["prediction"])


#: What a random candidate chooses from.
CHOICES = {"width": (0.08, 0.15, 0.25, 0.5, 0.8), "ridge": (1e-4, 1e-3, 1e-2), "novelty": (0.05, 0.1, 0.2), "most": (12, 20, 30), "radius": (1.5, 2.5, 4.0)}
FEATURE_SETS, TARGET_MODES = ("price", "lags", "dynamics"), ("level", "delta")


def candidate_grid(spark: SparkSession, n: int = 36, horizon: int = 1, seed: int = 42) -> DataFrame:
    """(candidate, feature_set, target_mode, width, ridge, novelty, most, radius): one seed per feature set, then n candidates whose
    feature sets and targets take turns and whose values are chosen by md5 of 'seed|horizon|index|name'."""
    if horizon < 1 or n < 0:
        raise ValueError("a horizon of at least 1 and no negative number of candidates")
    kinds = {"width": "double", "ridge": "double", "novelty": "double", "most": "int", "radius": "double"}
    typed = lambda v, c: F.lit(v).cast(kinds[c])
    first = spark.range(len(FEATURE_SETS)).select(
        F.concat(F.lit("seed_"), F.element_at(F.array(*map(F.lit, FEATURE_SETS)), F.col("id").cast("int") + 1)).alias("candidate"),
        F.element_at(F.array(*map(F.lit, FEATURE_SETS)), F.col("id").cast("int") + 1).alias("feature_set"), F.lit("level").alias("target_mode"),
        typed(0.5, "width").alias("width"), typed(1e-4, "ridge").alias("ridge"), typed(0.1, "novelty").alias("novelty"), typed(20, "most").alias("most"), typed(2.5, "radius").alias("radius"),
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f in FEATURE_SETS for t in TARGET_MODES])
    pick = lambda name, values: F.element_at(F.array(*[typed(v, name) for v in values]), (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(horizon), "id", F.lit(name)).cast("binary")), 1, 8), 16, 10).cast("long") % len(values)).cast("int") + 1).alias(name)
    pair = F.element_at(pairs, (F.col("id") % (len(FEATURE_SETS) * len(TARGET_MODES))).cast("int") + 1)
    drawn = spark.range(n).select(F.format_string("random_%03d", "id").alias("candidate"), pair["f"].alias("feature_set"), pair["t"].alias("target_mode"), *[pick(c, v) for c, v in CHOICES.items()])
    return first.unionByName(drawn)


#: Candidates are sent to every task; this bounds their table.
MOST_CANDIDATES = 10_000
#: Candidates that run in one group along a series: the series is copied once for so many of them.
CHUNK = 4


def listed(candidates: DataFrame) -> list:
    """The candidates on the driver, in order; too many are an error."""
    rows = candidates.orderBy("candidate").limit(MOST_CANDIDATES + 1).collect()
    if len(rows) > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates")
    return [r.asDict() for r in rows]


def chunked(df: DataFrame, keys: Sequence[str], n: int) -> GroupedData:
    """Each series once for every chunk of n candidates, numbered by ``_chunk``, and dealt to all partitions."""
    chunks = F.sequence(F.lit(0), F.lit((n - 1) // CHUNK)) if n else F.array().cast("array<int>")
    return dealt(df.withColumn("_chunk", F.explode(chunks)), [*keys, "_chunk"])


def search_learner(df: DataFrame, keys: Sequence[str], feature_sets: dict[str, Sequence[str]], targets: dict[str, str], origin: str, candidates: DataFrame, start: Column, date: str = "date", target_date: str = "target_date") -> DataFrame:
    """(candidate, n, mae, worst): each candidate runs along each series and is scored from ``start`` on.

    ``feature_sets`` and ``targets`` name columns: targets has level and delta; a delta is added to the origin before it is
    scored. ``worst`` is the largest mean error of a series. Too many candidates are an error.
    """
    grid = listed(candidates)
    columns = sorted({c for names in feature_sets.values() for c in names} | set(targets.values()) | {origin})
    x = chunked(df.select(*keys, date, target_date, *columns, start.alias("_scored")), keys, len(grid))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable").reset_index(drop=True)
        scored, known, rows = pdf["_scored"].fillna(False).to_numpy(bool), known_before(pdf[date], pdf[target_date]), []
        at = int(pdf["_chunk"].iloc[0]) * CHUNK
        for c in grid[at : at + CHUNK]:
            q, y = pdf[list(feature_sets[c["feature_set"]])].to_numpy(float), pdf[targets[c["target_mode"]]].to_numpy(float)
            got = learned(q, y, known, RuleLearner(q.shape[1], c["width"], c["novelty"], int(c["most"]), c["ridge"], c["radius"]))["prediction"].to_numpy()
            if c["target_mode"] == "delta":
                got = got + pdf[origin].to_numpy(float)
            e = np.abs(got - pdf[targets["level"]].to_numpy(float))[scored]
            e = e[np.isfinite(e)]
            rows.append((c["candidate"], float(e.sum()), len(e)))
        return pd.DataFrame(rows, columns=["candidate", "sae", "n"])

    one = x.applyInPandas(run, "candidate string, sae double, n long")
    return one.groupBy("candidate").agg(F.sum("n").alias("n"), (F.sum("sae") / F.nullif(F.sum("n"), F.lit(0))).alias("mae"), F.max(F.col("sae") / F.nullif(F.col("n"), F.lit(0))).alias("worst"))


def evaluate_learners(df: DataFrame, keys: Sequence[str], feature_sets: dict[str, Sequence[str]], targets: dict[str, str], origin: str, candidates: DataFrame, folds: DataFrame, date: str = "date", target_date: str = "target_date") -> DataFrame:
    """(candidate, fold_id, n, mae, rmse, rmse_ratio, rules, dictionary, clipped): learner candidates on every fold and series.

    Within a fold, features are scaled to [0, 1] by their range before its start and clipped; a level is scaled by the range of
    the labels known at the start, a delta is not. The learner takes the labels known at the start, then each as it becomes known.
    ``rmse_ratio`` is against the origin itself; ``rules`` and ``dictionary`` are the largest sizes within the fold, ``clipped`` is
    the share of feature values that were clipped. Folds and candidates are few and sent to the tasks; too many are an error.
    """
    grid = listed(candidates)
    spans = folds.select("fold_id", "start_date", "end_date").orderBy("fold_id").limit(MOST_FOLDS + 1).collect()
    if len(spans) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    spans = [(r["fold_id"], np.datetime64(r["start_date"]), np.datetime64(r["end_date"])) for r in spans]
    columns = sorted({c for names in feature_sets.values() for c in names} | set(targets.values()) | {origin})
    x = chunked(df.select(*keys, date, target_date, *columns), keys, len(grid))

    def ranged(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.fmin.reduce(values), np.fmax.reduce(values)
        return low, np.where(high > low, high - low, 1.0)

    def fold(pdf: pd.DataFrame, days: np.ndarray, known: np.ndarray, c: dict, start, end) -> tuple | None:
        a, b = np.searchsorted(days, start), np.searchsorted(days, end, side="right")
        if a == 0 or a >= b or not known[a]:
            return None
        raw, y = pdf[list(feature_sets[c["feature_set"]])].to_numpy(float)[:b], pdf[targets[c["target_mode"]]].to_numpy(float)[:b]
        level, base = pdf[targets["level"]].to_numpy(float)[a:b], pdf[origin].to_numpy(float)[a:b]
        low, width = ranged(raw[:a])
        scaled = (raw - low) / width
        q = np.clip(scaled, 0, 1)
        shift, size = ranged(y[: known[a]]) if c["target_mode"] == "level" else (0.0, 1.0)
        got = learned(q, (y - shift) / size, np.minimum(known[:b], b), RuleLearner(q.shape[1], c["width"], c["novelty"], int(c["most"]), c["ridge"], c["radius"]))[a:]
        guess = got["prediction"].to_numpy() * size + shift + (base if c["target_mode"] == "delta" else 0)
        ok = np.isfinite(guess) & np.isfinite(level) & np.isfinite(base)
        if not ok.any():
            return None
        e, naive, cut = (guess - level)[ok], (base - level)[ok], np.abs(scaled[a:] - q[a:])
        return int(ok.sum()), np.abs(e).sum(), (e**2).sum(), (naive**2).sum(), got["rules"].max(), got["dictionary"].max(), int((cut > 1e-12).sum()), int(np.isfinite(cut).sum())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable").reset_index(drop=True)
        days, known = pd.to_datetime(pdf[date]).to_numpy(), known_before(pdf[date], pdf[target_date])
        at = int(pdf["_chunk"].iloc[0]) * CHUNK
        got = [(c["candidate"], f, fold(pdf, days, known, c, start, end)) for c in grid[at : at + CHUNK] for f, start, end in spans]
        return pd.DataFrame([(c, f, *r) for c, f, r in got if r], columns=["candidate", "fold_id", "n", "sae", "sse", "naive", "rules", "dictionary", "cut", "seen"])

    one = x.applyInPandas(run, "candidate string, fold_id int, n long, sae double, sse double, naive double, rules double, dictionary double, cut long, seen long")
    return one.groupBy("candidate", "fold_id").agg(
        F.sum("n").alias("n"), (F.sum("sae") / F.sum("n")).alias("mae"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"),
        F.sqrt(F.sum("sse") / F.nullif(F.sum("naive"), F.lit(0.0))).alias("rmse_ratio"), F.max("rules").alias("rules"), F.max("dictionary").alias("dictionary"),
        (F.sum("cut") / F.nullif(F.sum("seen"), F.lit(0))).alias("clipped"),
    )


def residual_hybrid(df: DataFrame, keys: Sequence[str], features: Sequence[str], actual: str, base: str, weight: float = 0.5, limit: float = 0.05, date: str = "date") -> DataFrame:
    """Base forecast plus a weighted correction learned online from actual - base, limited to a share of the base."""
    c = corrections(df, keys, features, actual, base, date).withColumnRenamed("correction", "_c")
    top = limit * F.abs(base)
    return c.withColumn("prediction", F.col(base) + F.coalesce(F.greatest(-top, F.least(top, weight * F.col("_c"))), F.lit(0.0))).drop("_c")


def corrections(df: DataFrame, keys: Sequence[str], features: Sequence[str], actual: str, base: str, date: str = "date") -> DataFrame:
    """df with the ``correction`` that a learner of actual - base predicts."""
    c = online_learner(df.withColumn("_r", F.col(actual) - F.col(base)), keys, features, "_r", date=date)
    return df.join(c.select(*keys, date, F.col("prediction").alias("correction")), [*keys, date])


def hybrid_grid(df: DataFrame, actual: str, base: str, correction: str, weights: Sequence[float], limits: Sequence[float | None], fold: str) -> DataFrame:
    """(fold, weight, limit, n, mae, rmse, rmse_ratio): each weight and limit of a correction, by fold; the ratio is against the base.

    The correction does not depend on the grid, so it is learned once and all cells are summed in one pass; a limit is a share
    of the base's size, None means no limit, and a missing correction is none. Rows without actual or base don't count.
    """
    cells = [(float(w), None if t is None else float(t)) for w in weights for t in limits]
    x = df.filter(F.col(actual).isNotNull() & F.col(base).isNotNull())

    def error(w: float, t: float | None) -> Column:
        c = w * F.coalesce(F.col(correction), F.lit(0.0))
        top = None if t is None else t * F.abs(F.col(base))
        return F.col(base) + (c if t is None else F.greatest(-top, F.least(top, c))) - F.col(actual)

    sums = [F.struct(F.lit(w).alias("weight"), F.lit(t).cast("double").alias("limit"), F.avg(F.abs(error(w, t))).alias("mae"), F.avg(error(w, t) ** 2).alias("mse")) for w, t in cells]
    one = x.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(base) - F.col(actual)) ** 2).alias("_b"), F.array(*sums).alias("_c"))
    one = one.select(fold, "n", "_b", F.inline("_c"))
    return one.select(fold, "weight", "limit", "n", "mae", F.sqrt("mse").alias("rmse"), F.sqrt(F.col("mse") / F.nullif(F.col("_b"), F.lit(0.0))).alias("rmse_ratio"))


def evaluate_candidates(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, alphas: Sequence[float], folds: DataFrame, date: str = "date", target_date: str = "target_date") -> DataFrame:
    """(candidate, fold_id, mae, n): ridge candidates on every fold and series. Each (fold, series) is one group that sees rows up
    to the fold's end, fits every candidate on labels known at its start, and scores rows within it. Too many folds are an error."""
    f = folds.select("fold_id", "start_date", "end_date")
    if f.limit(MOST_FOLDS + 1).count() > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    grid = [float(a) for a in alphas]
    x = df.select(*keys, date, target_date, *features, target).join(F.broadcast(f), F.col(date) <= F.col("end_date"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pd.to_datetime(pdf["start_date"].iloc[0])
        a, b = pdf[list(features)].to_numpy(float), pdf[target].to_numpy(float)
        ok = np.isfinite(a).all(1) & np.isfinite(b)
        train, test = ok & (pd.to_datetime(pdf[target_date]) <= start).to_numpy(), ok & (pd.to_datetime(pdf[date]) >= start).to_numpy()
        if train.sum() < 20 or not test.any():
            return pd.DataFrame({"candidate": [], "fold_id": [], "sae": [], "n": []})
        sae = [np.abs(ridge(g)(a[train], b[train])(a[test]) - b[test]).sum() for g in grid]
        return pd.DataFrame({"candidate": range(len(grid)), "fold_id": pdf["fold_id"].iloc[0], "sae": sae, "n": int(test.sum())})

    one = dealt(x, [*keys, "fold_id"]).applyInPandas(run, "candidate int, fold_id int, sae double, n long")
    return one.groupBy("candidate", "fold_id").agg((F.sum("sae") / F.sum("n")).alias("mae"), F.sum("n").alias("n"))


def spread_walk_forward(df: DataFrame, keys: Sequence[str], spread: str, national: str, min_train: int = 52, max_reversion: float = 1.0, most_sigmas: float = 4.0, date: str = "date") -> DataFrame:
    """The spread returns to its own level: kappa and the level come from a regression of all earlier changes on the spread before
    them, by running sums. No Python.

    kappa is kept within [0, max_reversion]; at 0 the spread is carried on. A change beyond ``most_sigmas`` residual deviations
    is cut to them. prediction = national + spread + change; before ``min_train`` changes the spread is carried on.
    """
    w = by_date(keys, date)
    x = df.withColumns({"_x": F.lag(spread, 1).over(w)}).withColumn("_y", F.col(spread) - F.col("_x"))
    f = w.rowsBetween(W.unboundedPreceding, 0)
    n, y = F.count("_y").over(f), F.col("_y")
    sums = {c: F.sum(e).over(f) for c, e in {"_sx": F.when(y.isNotNull(), F.col("_x")), "_sy": y, "_sxx": F.when(y.isNotNull(), F.col("_x") * F.col("_x")), "_sxy": F.col("_x") * y, "_syy": y * y}.items()}
    x = x.withColumns({"_n": n, **sums})
    n, sx, sy = F.col("_n"), F.col("_sx"), F.col("_sy")
    cxx, cxy, cyy = F.col("_sxx") - sx * sx / n, F.col("_sxy") - sx * sy / n, F.col("_syy") - sy * sy / n
    slope = cxy / F.when(cxx > 0, cxx)
    x = x.withColumn("_b", F.when(n >= min_train, slope))
    x = x.withColumns({"kappa": F.when(F.col("_b").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(max_reversion), -F.col("_b")))), "_a": (sy - F.col("_b") * sx) / n, "_s": F.sqrt(F.greatest(F.lit(0.0), cyy - F.col("_b") * cxy) / F.nullif(n - 1, F.lit(0)))})
    change = F.when(F.col("kappa") > 0, F.col("_a") - F.col("kappa") * F.col(spread)).otherwise(0.0)
    top = F.when(F.col("_s") > 0, most_sigmas * F.col("_s")).otherwise(float("inf"))
    x = x.withColumn("prediction", F.col(national) + F.col(spread) + F.greatest(-top, F.least(top, F.coalesce(change, F.lit(0.0)))))
    return x.drop("_x", "_y", "_n", *sums, "_b", "_a", "_s")


def anchored_spread_walk_forward(df: DataFrame, keys: Sequence[str], spread: str, national: str, anchor: str, stations: str | None = None, pooled: str | None = None, own_weight: float = 1.0, min_train: int = 52, max_reversion: float = 0.5, most_anchor: float = 1.0, station_bounds=(0.25, 4.0), most_sigmas: float = 4.0, refit_every: int = 1, date: str = "date") -> DataFrame:
    """(keys, date, kappa, level, anchor_weight, prediction): the level slides with an anchor, level + weight * anchor.

    ``stations``: weeks are weighted by the number of stations over their median, within bounds; the median is that of the rows
    known at the origin. ``pooled``: a column with the reversion of all series, mixed in by 1 - own_weight. A row learns from changes up to
    its own; one without an anchor falls back to the level; one without a spread is NULL.
    """
    own = min(max(own_weight, 0.0), 1.0)

    def step(pdf):
        s, z = pdf[spread].to_numpy(float), pdf[anchor].to_numpy(float)
        before, z1 = np.r_[np.nan, s[:-1]], np.r_[np.nan, z[:-1]]
        y, size = s - before, pdf[stations].to_numpy(float) if stations else np.ones(len(s))
        all_series = pdf[pooled].to_numpy(float) if pooled else np.full(len(s), np.nan)
        ok = np.isfinite(y) & np.isfinite(z1) & np.isfinite(size)
        out, model, since = np.full((4, len(s)), np.nan), None, refit_every
        for i in range(len(s)):
            rows = np.flatnonzero(ok[: i + 1])
            if len(rows) >= min_train and since >= refit_every:
                a = np.column_stack([np.ones(len(rows)), before[rows], z1[rows]])
                root = np.sqrt(np.clip(size[rows] / max(np.median(size[rows]), 1.0), *station_bounds)) if stations else np.ones(len(rows))
                b = np.linalg.lstsq(a * root[:, None], y[rows] * root, rcond=None)[0]
                kappa = float(np.clip(-b[1], 0.0, max_reversion))
                if np.isfinite(all_series[i]):
                    kappa = float(np.clip(own * kappa + (1 - own) * all_series[i], 0.0, max_reversion))
                level, slide = (b[0] / kappa, float(np.clip(b[2] / kappa, -most_anchor, most_anchor))) if kappa > 0 else (before[rows].mean(), 0.0)
                model, since = (kappa, level, slide, most_sigmas * np.std(y[rows] - a @ b, ddof=1)), 0
            since += 1
            if model and np.isfinite(s[i]):
                kappa, level, slide, top = model
                change = kappa * (level + (slide * z[i] if np.isfinite(z[i]) else 0.0) - s[i])
                out[:, i] = kappa, level, slide, s[i] + (float(np.clip(change, -top, top)) if top > 0 else change)
        return pd.DataFrame({"kappa": out[0], "level": out[1], "anchor_weight": out[2], "_spread": out[3]})

    columns = [spread, anchor, *([stations] if stations else []), *([pooled] if pooled else [])]
    got = per_series(df.select(*keys, date, *columns), keys, ["kappa", "level", "anchor_weight", "_spread"], step, date)
    got = nulls(got, ["kappa", "level", "anchor_weight", "_spread"])
    return df.select(*keys, date, national).join(got, [*keys, date]).withColumn("prediction", F.col(national) + F.col("_spread")).drop(national, "_spread")


def minmax_scale(df: DataFrame, keys: Sequence[str], col: str, train: Column) -> DataFrame:
    """Scaled to [0, 1] by the training rows' range and clipped; a constant column gives 0."""
    a = df.filter(train).groupBy(*keys).agg(F.min(col).alias("_a"), F.max(col).alias("_b"))
    z = F.coalesce((F.col(col) - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)), F.when(F.col(col).isNotNull(), 0.0))
    return df.join(a, list(keys), "left").withColumns({"scaled": F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)), "clipped": (z < 0) | (z > 1)}).drop("_a", "_b")


def robust_scale(df: DataFrame, keys: Sequence[str], col: str, train: Column) -> DataFrame:
    """arctan of the distance from the training median in interquartile ranges, over pi/2."""
    a = df.filter(train).groupBy(*keys).agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    z = (F.col(col) - F.col("_q")[1]) / F.nullif(F.col("_q")[2] - F.col("_q")[0], F.lit(0.0))
    return df.join(a, list(keys), "left").withColumn("scaled", F.atan(z) * 2 / F.pi()).drop("_q")


def rbf_features(df: DataFrame, ident: str, vector: str, landmarks: DataFrame, sigma: float, most_landmarks: int = 4096) -> DataFrame:
    """(ident, landmark, kernel) of every vector with each of a checked number of landmarks (landmark, point), which are broadcast."""
    if landmarks.limit(most_landmarks + 1).count() > most_landmarks:
        raise ValueError(f"more than {most_landmarks} landmarks")
    both = df.select(ident, vector).join(F.broadcast(landmarks.select("landmark", "point")))
    d2 = F.aggregate(F.zip_with(vector, "point", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return both.select(ident, "landmark", F.exp(-d2 / (2 * sigma * sigma)).alias("kernel"))


def release_forecast(df: DataFrame, keys: Sequence[str], price: str, primary: str, width: int = 156, date: str = "date") -> DataFrame:
    """Primary forecast, guarded by the size of recent moves, with a band of past residual quantiles that always holds the point."""
    from .features import change_guard

    x = change_guard(df, keys, price, primary, width, date=date)
    x = with_quantiles(x, keys, "resid", [0.1, 0.9], -width, -1, 20, date)
    p = F.col("guard_forecast")
    return x.select(*keys, date, p.alias("point"), "guarded", F.least(p, p + F.col("_q")[0]).alias("p10"), F.greatest(p, p + F.col("_q")[1]).alias("p90"))


def refit_epochs(df: DataFrame, weeks: int, min_rows: int, date: str = "date", target_date: str = "target_date") -> list[tuple[str, str]]:
    """[start, end) of refits every so many weeks, from the first date by which ``min_rows`` labels are known to the last date.

    The driver reads two dates; epochs are as many as the years hold.
    """
    per = df.groupBy(target_date).agg(F.count(F.lit(1)).alias("_n"))
    known = per.withColumn("_k", F.sum("_n").over(W.orderBy(target_date)))  # one row a date, in all
    first, last = known.filter(F.col("_k") >= min_rows).agg(F.min(target_date)).first()[0], df.agg(F.max(date)).first()[0]
    out, step = [], timedelta(weeks=weeks)
    while first is not None and last is not None and first <= last:
        out.append((str(first), str(first + step)))
        first += step
    return out


def boosted_trees(df: DataFrame, features: Sequence[str], target: str, epochs: Sequence[tuple[str, str]], date: str = "date", target_date: str = "target_date", rounds: int = 20, depth: int = 4) -> DataFrame:
    """(…, prediction) per refit epoch [start, end): MLlib boosted trees, pooled over all series, of the labels known at its start."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    path = new_folder(df.sparkSession, "labelled")
    df.write.parquet(path)  # each fit reads it again
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    x = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="skip").transform(df.filter(F.col(target).isNotNull()))
    out = None
    for a, b in epochs:
        train = x.filter(F.col(target_date) <= F.lit(a).cast("date"))
        model = GBTRegressor(featuresCol="_f", labelCol=target, predictionCol="prediction", maxIter=rounds, maxDepth=depth, seed=1).fit(train)
        got = model.transform(x.filter((F.col(date) >= F.lit(a).cast("date")) & (F.col(date) < F.lit(b).cast("date")))).drop("_f")
        out = got if out is None else out.unionByName(got)
    return out
