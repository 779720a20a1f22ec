"""Decisions from forecasts: replays inside unbroken blocks, recommendations, costs, freshness."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import calendar_target
from .features import contiguous_blocks, over
from .score import prebuy_replay, profitability


def block_replay(pred: DataFrame, keys: Sequence[str], horizon: int, liters: float, share: float, threshold: float, carry: float, date: str = "date") -> DataFrame:
    """The replay inside unbroken blocks of three weeks or more, summed per key and block."""
    return profitability(prebuy_replay(contiguous_blocks(pred, keys, date=date), keys, horizon, liters, share, threshold, carry), [*keys, "block"])


def decide(forecasts: DataFrame, challengers: DataFrame, customers: DataFrame, on: Sequence[str], threshold: float, share: float) -> DataFrame:
    """One row per customer: recommend ('buy_early' or 'wait'), liters, saving, agreement, confidence.

    forecasts (on, origin, prediction), challengers (on, challenger), customers (on[0], customer, volume, scope). A challenger of another week
    doesn't join, so it is ignored (agreement NULL). The rise must exceed the threshold strictly; state scope caps confidence at 'medium'.
    """
    x = forecasts.join(challengers.select(*on, "challenger"), list(on), "left")
    rise = F.col("prediction") - F.col("origin")
    x = x.withColumns({"rise": rise, "agreement": F.signum(rise) == F.signum(F.col("challenger") - F.col("origin"))})
    x = x.join(customers, on[0])
    buy = F.coalesce(F.col("rise") > threshold, F.lit(False))
    liters = F.when(buy, F.col("volume") * share).otherwise(0.0)
    level = F.when(F.col("agreement").isNull(), "low").when(~F.col("agreement"), "low").when(F.col("scope") == "state", "medium").otherwise("high")
    return x.withColumns({"recommend": F.when(buy, "buy_early").otherwise("wait"), "liters": liters, "saving": liters * F.col("rise"), "exposure": F.col("volume") * F.col("rise"), "confidence": level})


def cost_scenario(forecasts: DataFrame, volumes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Current, forecast, low and high cost of each volume, and what one cent of price costs."""
    v = F.col("volume")
    return forecasts.join(volumes, list(on)).withColumns({"current_cost": v * F.col("origin"), "forecast_cost": v * F.col("prediction"), "low_cost": v * F.col("lower"), "high_cost": v * F.col("upper"), "per_cent": v * 0.01})


def basis_cost(basis: DataFrame, volumes: DataFrame, on: Sequence[str], weeks: int = 52) -> DataFrame:
    """Yearly budget error (mean absolute spread) and yearly gap at today's spread for a weekly volume."""
    year = F.col("volume") * weeks
    return basis.join(volumes, list(on)).withColumns({"budget_error": year * F.col("mean_abs_spread"), "current_gap": year * F.col("spread")})


def gate_by_pressure(pred: DataFrame, press: DataFrame, on: Sequence[str], z: str = "press_z") -> DataFrame:
    """The prediction only where the pressure is negative, else (or where it is unknown) the origin price."""
    return pred.join(press.select(*on, z), list(on), "left").withColumn("gated", F.when(F.col(z) < 0, F.col("prediction")).otherwise(F.col("origin")))


def horizon_sweep(prices: DataFrame, keys: Sequence[str], price: str, horizons: Sequence[int], width: int = 4, date: str = "date", threshold: float = 0.0, carry: float = 0.0) -> DataFrame:
    """(keys, horizon, n, mae, ratio, triggers, saving, status) of the running mean against the last price; 'unavailable' without a full pair.

    ``saving``: what buying a litre early would have saved in all weeks in which the mean was ``threshold`` above the price or more, less
    ``carry`` a week.

    One calendar join per horizon: the list of horizons is short and fixed by the caller.
    """
    out = None
    p = prices.withColumn("_m", over(F.avg, price, keys, 1 - width, 0, 1, date))
    for h in horizons:
        hit = F.col("target").isNotNull() & (F.col("_m") - F.col(price) >= threshold)
        saved = F.sum(F.when(hit, F.col("target") - F.col(price) - carry * h).otherwise(0.0))
        x = calendar_target(p, keys, price, h, date).groupBy(*keys).agg(F.count("target").alias("n"), F.count(F.when(hit, 1)).alias("triggers"), saved.alias("saving"), F.avg(F.abs(F.col("_m") - F.col("target"))).alias("mae"), F.avg(F.abs(F.col(price) - F.col("target"))).alias("_b"))
        x = x.select(*keys, F.lit(h).alias("horizon"), "n", "mae", (F.col("mae") / F.nullif("_b", F.lit(0.0))).alias("ratio"), "triggers", "saving", F.when(F.col("n") == 0, "unavailable").otherwise("available").alias("status"))
        out = x if out is None else out.unionByName(x)
    return out


def freshness(target: Column, today: Column, grace: int = 6, block_after: int = 14) -> tuple[Column, Column]:
    """(status, stale days): healthy until ``grace`` days after the target, then degraded, later blocked; NULL targets are blocked."""
    stale = F.greatest(F.datediff(today, target) - grace, F.lit(0))
    return F.when(stale.isNull() | target.isNull(), "blocked").when(stale == 0, "healthy").when(stale <= block_after, "degraded").otherwise("blocked"), stale


def health_report(pred: DataFrame, keys: Sequence[str], alpha: float = 0.2, at_least: int = 20, date: str = "date", clip: str | None = None, capacity: str | None = None, churn: str | None = None) -> DataFrame:
    """(n, coverage, mae, alerts) per key: low coverage, worse than the last price, missed weeks; by the last row's share of clipped features
    (``clip`` above 0.25), of used capacity (0.9 or more) and of replaced dictionary entries (0.1 or more), where these columns are named."""
    from .align import by_date

    gap = F.datediff(date, F.lag(date, 1).over(by_date(keys, date)))
    x = pred.withColumns({"_gap": gap, "_e": F.abs(F.col("prediction") - F.col("actual")), "_b": F.abs(F.col("origin") - F.col("actual"))})
    inside = F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")
    last = [(n, c, m) for n, c, m in (("clip", clip, 0.25), ("capacity", capacity, 0.9), ("churn", churn, 0.1)) if c]
    one = x.groupBy(*keys).agg(*[F.max_by(c, date).alias(f"_{n}") for n, c, _ in last], F.count("_e").alias("n"), F.avg(inside).alias("coverage"), F.avg("_e").alias("mae"), F.avg("_b").alias("_base"), F.count(F.when(F.col("_gap") != 7, 1)).alias("missed"))
    enough = F.col("n") >= at_least
    alerts = F.array_compact(F.array(F.when(enough & (F.col("coverage") < 1 - alpha - 0.1), "coverage"), F.when(enough & (F.col("mae") > F.col("_base")), "mae"), F.when(F.col("missed") > 0, "cadence"),
        *[F.when(F.col(f"_{name}") > most if name == "clip" else F.col(f"_{name}") >= most, name) for name, _, most in last]))
    return one.withColumn("alerts", F.concat_ws(",", alerts)).drop("_base", *[f"_{name}" for name, _, _ in last])
