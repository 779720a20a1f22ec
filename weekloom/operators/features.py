"""Window features. Rolling values skip NULLs and appear once enough values are there; lagged frames end one row before.

Without keys the whole table is one series: those of the features that look at a bounded number of rows, running sums or last
values are then taken range by range (``scan``), never in one task.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan
from .align import by_date
from .ranks import with_quantiles


def over(fn: Callable, col, keys: Sequence[str], start: int, end: int, at_least: int, date: str = "date") -> Column:
    """fn(col) over the rows start..end around each row, NULL with fewer than ``at_least`` values."""
    w = by_date(keys, date).rowsBetween(start, end)
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(col).over(w) >= at_least, fn(col).over(w))


def past(fn: Callable, col, keys: Sequence[str], at_least: int, date: str = "date") -> Column:
    return over(fn, col, keys, W.unboundedPreceding, -1, at_least, date)


def weekly_features(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lags=(1, 2, 4, 8, 12), means=(4, 8, 12), date: str = "date") -> DataFrame:
    """Lags, lagged means and lagged volatility of log changes."""
    if not keys:
        return scan.in_ranges(df, keys, date, lambda x, k: weekly_features(x, k, columns, lags, means, date), max(*lags, *means) + 1)
    w = by_date(keys, date)
    df = df.withColumns({f"_c_{c}": F.log(c) - F.log(F.lag(c, 1).over(w)) for c in columns})
    out = {f"{c}_l{k}": F.lag(c, k).over(w) for c in columns for k in lags}
    out |= {f"{c}_ma{m}": over(F.avg, c, keys, -m, -1, m, date) for c in columns for m in means}
    out |= {f"{c}_vol{m}": over(F.stddev_samp, f"_c_{c}", keys, -m, -1, max(3, m // 2), date) for c in columns for m in means}
    return df.withColumns(out).drop(*[f"_c_{c}" for c in columns])


def price_jump_proxy(df: DataFrame, keys: Sequence[str], col: str, date: str = "date", window: int = 12, at_least: int = 4, times: float = 2.5, floor: float = 1e-4) -> DataFrame:
    """jump: the log change is beyond ``times`` its rolling deviation; z: the value against its rolling mean; adjusted: a jump, or a z beyond 2."""
    if not keys:
        return scan.in_ranges(df, keys, date, lambda x, k: price_jump_proxy(x, k, col, date, window, at_least, times, floor), window)
    df = df.withColumn("_d", F.log(col) - F.log(F.lag(col, 1).over(by_date(keys, date))))
    sd = F.greatest(over(F.stddev_samp, "_d", keys, 1 - window, 0, at_least, date), F.lit(floor))
    z = (F.col(col) - over(F.avg, col, keys, 1 - window, 0, at_least, date)) / over(F.stddev_samp, col, keys, 1 - window, 0, at_least, date)
    jump = F.coalesce(F.abs("_d") > times * sd, F.lit(False))
    return df.withColumns({"jump": jump, "z": z, "adjusted": jump | F.coalesce(F.abs(z) > 2, F.lit(False))}).drop("_d")


def feature_set(df: DataFrame, keys: Sequence[str], col: str, kind: str = "dynamics", date: str = "date", warm: int = 13, exogenous: Sequence[str] = ()) -> DataFrame:
    """'price', 'lags', 'dynamics' or 'exogenous' features on the grid; rows without ``warm`` unbroken weeks get NULLs.

    'exogenous' has the level, changes over 1 and 4 weeks, the gap to the mean of 8, the deviation of 12, and last week's value of the
    columns that are named (at least one).
    """
    if kind == "exogenous" and not exogenous:
        raise ValueError("an exogenous set needs columns")
    if not keys:
        return scan.in_ranges(df, keys, date, lambda x, k: feature_set(x, k, col, kind, date, warm, exogenous), max(warm, 13))
    w = by_date(keys, date)
    p = F.col(col)
    lag = lambda k: F.lag(col, k).over(w)
    whole = F.count(col).over(w.rowsBetween(1 - warm, 0)) == warm
    out: dict[str, Column] = {"level": p}
    if kind in ("lags", "dynamics"):
        out |= {f"lag_{k}": lag(k) for k in range(1, 13)}
    if kind == "dynamics":
        out |= {f"change_{k}": (p - lag(k)) / k for k in (1, 2, 4, 8)}
        out |= {f"gap_ma{k}": p - F.avg(col).over(w.rowsBetween(1 - k, 0)) for k in (4, 8)}
        df = df.withColumn("_d", p - lag(1))
        out |= {f"vol_{k}": F.stddev_pop("_d").over(w.rowsBetween(1 - k, 0)) for k in (4, 12)}
    if kind == "exogenous":
        df = df.withColumn("_d", p - lag(1))
        out |= {"change_1": p - lag(1), "change_4": (p - lag(4)) / 4, "gap_ma8": p - F.avg(col).over(w.rowsBetween(-7, 0)), "vol_12": F.stddev_pop("_d").over(w.rowsBetween(-11, 0))}
        out |= {f"{c}_l1": F.lag(c, 1).over(w) for c in exogenous}
    return df.withColumns({k: F.when(whole, v) for k, v in out.items()}).drop("_d")


def expanding_coint_residual(df: DataFrame, keys: Sequence[str], y: str, x: str, warmup: int, date: str = "date", out: str = "coint") -> DataFrame:
    """Residual of log y on log x, fitted on all earlier rows by running sums, over its own earlier deviation."""
    if not keys:
        return scan.expanding_coint_residual(df, keys, y, x, warmup, date, out)
    ly, lx = F.log(y), F.log(x)
    df = df.withColumns({"_y": F.when(lx.isNotNull(), ly), "_x": F.when(ly.isNotNull(), lx)})
    s = lambda c: F.sum(c).over(by_date(keys, date).rowsBetween(W.unboundedPreceding, -1))
    n = F.count("_x").over(by_date(keys, date).rowsBetween(W.unboundedPreceding, -1))
    sx, sy, sxx, sxy = s(F.col("_x")), s(F.col("_y")), s(F.col("_x") * F.col("_x")), s(F.col("_x") * F.col("_y"))
    slope = (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))
    df = df.withColumns({"_n": n, "_slope": slope, "_mx": sx / n, "_my": sy / n})
    df = df.withColumn("_r", F.when(F.col("_n") >= warmup, F.col("_y") - F.col("_my") - F.col("_slope") * (F.col("_x") - F.col("_mx"))))
    sd = past(F.stddev_samp, "_r", keys, 2, date)
    return df.withColumn(out, F.col("_r") / F.nullif(sd, F.lit(0.0))).drop("_y", "_x", "_n", "_slope", "_mx", "_my", "_r")


def passthrough_panel(df: DataFrame, keys: Sequence[str], price: str, cost: str, warmup: int = 52, date: str = "date") -> DataFrame:
    """Weekly change, its lag, lagged cost moves, the cointegration residual, volatility and the cost move's size."""
    w = by_date(keys, date)
    df = df.withColumns({"dp": F.col(price) - F.lag(price, 1).over(w), "_c": F.log(cost) - F.log(F.lag(cost, 1).over(w))})
    df = expanding_coint_residual(df, keys, price, cost, warmup, date)
    moves = {f"cost_{k}": F.lag("_c", k).over(w) * F.lag(price, 1).over(w) for k in range(4)}
    return df.withColumns({"dp1": F.lag("dp", 1).over(w), **moves, "coint1": F.lag("coint", 1).over(w), "vol26": over(F.stddev_samp, "dp", keys, -26, -1, 12, date), "abs_cost": F.abs("_c")}).drop("_c")


def parity_panel(df: DataFrame, keys: Sequence[str], price: str, parity: str, producer: str, producer_lag: int = 1, warmup: int = 52, date: str = "date", crude: str | None = None) -> DataFrame:
    """The pass-through panel on import parity, with the producer's lagged move and, with a ``crude`` column, last week's log change of it."""
    w = by_date(keys, date)
    out = passthrough_panel(df, keys, price, parity, warmup, date)
    if crude:
        out = out.withColumn("crude_move", F.log(F.lag(crude, 1).over(w)) - F.log(F.lag(crude, 2).over(w)))
    return out.withColumn("producer_move", F.lag(producer, producer_lag).over(w) - F.lag(producer, producer_lag + 1).over(w))


def with_next_week(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """One more row per key, a week after its last, all values NULL: features of it are those for the unobserved week."""
    return df.unionByName(df.groupBy(*keys).agg(F.date_add(F.max(date), 7).alias(date)), allowMissingColumns=True)


def causal_z(df: DataFrame, keys: Sequence[str], col: str, warmup: int, out: str, date: str = "date") -> DataFrame:
    """The value standardised on strictly earlier rows."""
    return df.withColumn(out, (F.col(col) - past(F.avg, col, keys, warmup, date)) / F.nullif(past(F.stddev_samp, col, keys, warmup, date), F.lit(0.0)))


def pressure_features(df: DataFrame, keys: Sequence[str], price: str, parity: str, producer: str, lag: int = 1, warmup: int = 52, date: str = "date") -> DataFrame:
    """log producer (lagged) less log parity (last week), standardised causally, scaled by price, and its change."""
    w = by_date(keys, date)
    df = df.withColumn("press", F.log(F.lag(producer, lag).over(w)) - F.log(F.lag(parity, 1).over(w)))
    df = causal_z(df, keys, "press", warmup, "press_z", date)
    return df.withColumns({"press_p": F.col("press_z") * F.lag(price, 1).over(w), "press_d": F.col("press_z") - F.lag("press_z", 1).over(w)})


def regional_features(df: DataFrame, keys: Sequence[str], state: str, national: str, producer_spread: str, warmup: int = 104, date: str = "date") -> DataFrame:
    w = by_date(keys, date)
    df = df.withColumn("spread", F.col(state) - F.col(national))
    df = df.withColumns({"spread_d": F.col("spread") - F.lag("spread", 1).over(w), "spread_l1": F.lag("spread", 1).over(w), "producer_l3": F.lag(producer_spread, 3).over(w)})
    return causal_z(df, keys, "spread", warmup, "spread_z", date)


def rolling_rmse(df: DataFrame, keys: Sequence[str], y: str, yhat: str, width: int = 12, date: str = "date") -> DataFrame:
    """From row ``width`` on: root mean square of the errors that are there."""
    if not keys:
        return scan.in_ranges(df, keys, date, lambda x, k: rolling_rmse(x, k, y, yhat, width, date), width - 1)
    w = by_date(keys, date)
    e = F.col(y) - F.col(yhat)
    return df.withColumn("rmse", F.when(F.row_number().over(w) >= width, F.sqrt(F.avg(e * e).over(w.rowsBetween(1 - width, 0)))))


def expanding_conformal(df: DataFrame, keys: Sequence[str], resid: str, yhat: str, at_least: int = 20, low: float = 0.1, high: float = 0.9, date: str = "date") -> DataFrame:
    """Band from the exact quantiles of all earlier residuals."""
    return with_quantiles(df, keys, resid, [low, high], None, -1, at_least, date).withColumns({"lower": F.col(yhat) + F.col("_q")[0], "upper": F.col(yhat) + F.col("_q")[1]}).drop("_q")


def moving_band(df: DataFrame, keys: Sequence[str], resid: str, yhat: str, width: int = 156, nominal: float = 0.8, at_least: int = 20, date: str = "date") -> DataFrame:
    tail = (1 - nominal) / 2
    return with_quantiles(df, keys, resid, [tail, 1 - tail], -width, -1, at_least, date).withColumns({"lower": F.col(yhat) + F.col("_q")[0], "upper": F.col(yhat) + F.col("_q")[1]}).drop("_q")


def change_guard(df: DataFrame, keys: Sequence[str], price: str, yhat: str, width: int = 156, floor: float = 0.10, date: str = "date") -> DataFrame:
    """limit = max(floor, twice the 99.5 % quantile of recent moves); a forecast beyond it falls back to the price."""
    if not keys:
        return scan.in_ranges(df, keys, date, lambda x, k: change_guard(x, k, price, yhat, width, floor, date), width)
    df = df.withColumn("_m", F.abs(F.col(price) - F.lag(price, 1).over(by_date(keys, date))))
    df = with_quantiles(df, keys, "_m", [0.995], 1 - width, 0, 1, date)
    df = df.withColumn("limit", F.greatest(F.lit(floor), 2 * F.col("_q")[0])).drop("_q")
    beyond = F.abs(F.col(yhat) - F.col(price)) > F.col("limit")
    return df.withColumns({"guarded": F.coalesce(beyond, F.lit(False)), "guard_forecast": F.when(beyond, F.col(price)).otherwise(F.col(yhat))}).drop("_m")


def contiguous_blocks(df: DataFrame, keys: Sequence[str], step: int = 7, at_least: int = 3, date: str = "date") -> DataFrame:
    """block: islands of unbroken weeks, those of ``at_least`` rows."""
    if not keys:
        return scan.contiguous_blocks(df, keys, step, at_least, date)
    new = F.coalesce(F.datediff(date, F.lag(date, 1).over(by_date(keys, date))) != step, F.lit(True)).cast("int")
    df = df.withColumn("_new", new).withColumn("block", F.sum("_new").over(by_date(keys, date).rowsBetween(W.unboundedPreceding, 0)))
    return df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys, "block"))).filter(F.col("_n") >= at_least).drop("_new", "_n")


def episodes(df: DataFrame, keys: Sequence[str], mask: Column, min_gap: int = 8, date: str = "date") -> DataFrame:
    """Masked rows with an episode number: a new one where more than ``min_gap`` weeks have passed."""
    if not keys:
        return scan.episodes(df, keys, mask, min_gap, date)
    own = df.filter(mask)
    new = F.coalesce(F.datediff(date, F.lag(date, 1).over(by_date(keys, date))) > 7 * min_gap, F.lit(True)).cast("int")
    return own.withColumn("_new", new).withColumn("episode", F.sum("_new").over(by_date(keys, date).rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def spread_opportunity(df: DataFrame, keys: Sequence[str], spread: str, horizon: int, shares=(0.02, 0.05, 0.10), date: str = "date") -> DataFrame:
    """Per key and low quantile: weeks, episodes, mean forward change, share of rises, and where the last value stands now (z, percentile)."""
    ahead = df.withColumn("_f", F.lead(spread, horizon).over(by_date(keys, date)) - F.col(spread))
    cut = df.groupBy(*keys).agg(F.percentile(spread, F.array(*[F.lit(s) for s in shares])).alias("_q"))
    cut = cut.select(*keys, F.posexplode("_q").alias("_i", "cut")).withColumn("share", F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("_i") + 1)).drop("_i")
    low = episodes(ahead.join(cut, list(keys)), [*keys, "share"], F.col(spread) <= F.col("cut"), date=date)
    one = low.groupBy(*keys, "share").agg(F.count(F.lit(1)).alias("weeks"), F.max("episode").alias("episodes"), F.avg("_f").alias("mean_forward"), F.avg((F.col("_f") > 0).cast("double")).alias("share_up"))
    return one.join(basis_report(df, keys, spread, spread, date=date).select(*keys, F.col("z").alias("z_now"), F.col("percentile").alias("percentile_now")), list(keys))


def basis_report(df: DataFrame, keys: Sequence[str], price: str, spread: str, weeks: int = 52, date: str = "date") -> DataFrame:
    """Latest price and spread, mean absolute spread of the last weeks, z and percentile rank."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(date)))
    last = F.max_by(spread, date)
    x = df.filter(F.col(spread).isNotNull()).withColumn("_n", n)
    one = x.groupBy(*keys).agg(F.max_by(price, date).alias("price"), last.alias("spread"), F.avg(F.when(F.col("_n") <= weeks, F.abs(spread))).alias("mean_abs_spread"), ((last - F.avg(spread)) / F.nullif(F.stddev_samp(spread), F.lit(0.0))).alias("z"))
    rank = x.select(*keys, F.col(spread).alias("_s")).join(one.select(*keys, F.col("spread").alias("_l")), list(keys)).groupBy(*keys).agg(F.avg((F.col("_s") <= F.col("_l")).cast("double")).alias("percentile"))
    return one.join(rank, list(keys))


def horizon_predictability(df: DataFrame, keys: Sequence[str], col: str, horizons=(1, 2, 4, 8, 12, 26), date: str = "date") -> DataFrame:
    """R2 between the distance from the expanding mean and the change over each horizon."""
    df = df.withColumn("_g", F.col(col) - past(F.avg, col, keys, 1, date))
    df = df.withColumns({f"_d{h}": F.lead(col, h).over(by_date(keys, date)) - F.col(col) for h in horizons})
    one = df.groupBy(*keys).agg(*[(F.corr("_g", f"_d{h}") * F.corr("_g", f"_d{h}")).alias(f"_{h}") for h in horizons])
    return one.select(*keys, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}").alias("r2")) for h in horizons])).alias("x")).select(*keys, "x.*")


def worst_rolling_ratio(df: DataFrame, keys: Sequence[str], err_a: str, err_b: str, width: int = 13, date: str = "date") -> DataFrame:
    ratio = F.sqrt(over(F.avg, F.col(err_a) * F.col(err_a), keys, 1 - width, 0, width, date) / F.nullif(over(F.avg, F.col(err_b) * F.col(err_b), keys, 1 - width, 0, width, date), F.lit(0.0)))
    return df.withColumn("_r", ratio).groupBy(*keys).agg(F.max("_r").alias("worst_ratio"))
