"""Scoring of forecasts: long frames with actual, origin, prediction and, where given, lower and upper."""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ERR() -> Column:
    """Error of the prediction."""
    return F.col("prediction") - F.col("actual")


def regression_metrics(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mse, rmse, mae, smape (0/0 counts as 0) and the error over the deviation of the actuals."""
    e = ERR()
    size = F.abs("actual") + F.abs("prediction")
    return pred.dropna(subset=["actual", "prediction"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(size == 0, 0.0).otherwise(2 * F.abs(e) / size)).alias("smape"), (F.sqrt(F.avg(e * e)) / F.nullif(F.stddev_pop("actual"), F.lit(0.0))).alias("ndei"),
    )


def directional_accuracy() -> Column:
    """Of rows that moved, the share whose direction was right."""
    moved = F.col("actual") != F.col("origin")
    return F.avg(F.when(moved, (F.signum(F.col("prediction") - F.col("origin")) == F.signum(F.col("actual") - F.col("origin"))).cast("double")))


def pinball(quantile: str, tau: float) -> Column:
    d = F.col("actual") - F.col(quantile)
    return F.avg(F.greatest(tau * d, (tau - 1) * d))


def coverage() -> Column:
    return F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double"))


def accuracy_report(pred: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Errors overall, in quiet weeks (move <= threshold) and in events (>), direction, and the largest error's share."""
    e, event = ERR(), F.abs(F.col("actual") - F.col("origin")) > threshold
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(event, 1)).alias("n_event"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(event, F.abs(e))).alias("mae_event"), F.avg(F.when(~event, F.abs(e))).alias("mae_quiet"), directional_accuracy().alias("direction"),
        (F.max(e * e) / F.nullif(F.sum(e * e), F.lit(0.0))).alias("largest_share"),
    )


def metric_row(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    e = ERR()
    naive = F.avg(F.abs(F.col("origin") - F.col("actual")))
    return pred.groupBy(*by).agg(F.avg(e).alias("bias"), F.max(F.abs(e)).alias("max_abs"), F.median(F.abs(e)).alias("median_abs"), (F.avg(F.abs(e)) / F.nullif(naive, F.lit(0.0))).alias("ratio_naive"))


def winkler(alpha: float, lower: str = "lower", upper: str = "upper") -> Column:
    """Interval score of a row: width, and 2/alpha for each unit outside."""
    out = F.greatest(F.col(lower) - F.col("actual"), F.col("actual") - F.col(upper), F.lit(0.0))
    return F.col(upper) - F.col(lower) + 2.0 / alpha * out


def interval_report(pred: DataFrame, by: Sequence[str], alpha: float, threshold: float) -> DataFrame:
    event, width = F.abs(F.col("actual") - F.col("origin")) > threshold, F.col("upper") - F.col("lower")
    inside = F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")
    return pred.dropna(subset=["lower", "upper"]).groupBy(*by).agg(
        coverage().alias("coverage"), (coverage() - (1 - alpha)).alias("calibration_error"), F.avg(width).alias("mean_width"), F.median(width).alias("median_width"),
        F.avg(winkler(alpha)).alias("winkler"), F.avg(F.when(event, inside)).alias("coverage_event"), F.avg(F.when(~event, inside)).alias("coverage_quiet"),
        (F.avg(F.when(event, width)) / F.nullif(F.avg(F.when(~event, width)), F.lit(0.0))).alias("width_ratio"),
    )


def performance_report(pred: DataFrame, by: Sequence[str], threshold: float, cents=(0.01, 0.02, 0.05, 0.10)) -> DataFrame:
    """Share of right directions (of all rows that moved, of events, of quiet rows that moved), of errors within so many cents, and
    of actuals inside the band (lower, upper)."""
    e, moved, event = F.abs(ERR()), F.col("actual") != F.col("origin"), F.abs(F.col("actual") - F.col("origin")) > threshold
    right = (F.signum(F.col("prediction") - F.col("origin")) == F.signum(F.col("actual") - F.col("origin"))).cast("double")
    return pred.groupBy(*by).agg(
        directional_accuracy().alias("hit_rate"), F.avg(F.when(event, right)).alias("hit_rate_event"), F.avg(F.when(~event & moved, right)).alias("hit_rate_quiet"), F.count(F.when(event, 1)).alias("n_event"),
        *[F.avg((e <= c).cast("double")).alias(f"within_{round(100 * c)}") for c in cents], F.median(e).alias("median_abs"), F.avg(e).alias("mean_abs"), coverage().alias("coverage"),
    )


def cohen_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement of two labels; where chance alone agrees fully, 1 if they always agree, else 0. Two small aggregations."""
    d = df.dropna(subset=[a, b])
    n = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"))
    side = lambda c, m: d.groupBy(*by, F.col(c).alias("_l")).agg(F.count(F.lit(1)).alias(m))
    both = side(a, "na").join(side(b, "nb"), [*by, "_l"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("s"))
    out = n.join(both, list(by), "left") if by else n.join(both, how="cross")  # one row each
    expected = F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*by, "n", "observed", F.when(expected == 1, (F.col("observed") == 1).cast("double")).otherwise((F.col("observed") - expected) / (1 - expected)).alias("kappa"))


def block_bootstrap(df: DataFrame, keys: Sequence[str], value: str, order: str, block: int, resamples: int, seed: int = 1) -> DataFrame:
    """(keys, resample, mean) of moving-block resamples: from prefix sums, never from resampled rows.

    A block's start is the first 32 bits of md5('seed|resample|block') modulo the number of starts, so any engine can repeat it.
    """
    w = W.partitionBy(*keys).orderBy(order)
    p = df.select(*keys, (F.row_number().over(w)).alias("_i"), F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_s"))
    n = p.groupBy(*keys).agg(F.max("_i").alias("_n")).withColumn("_b", F.least(F.lit(block), F.col("_n")))
    draws = n.select(*keys, "_n", "_b", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / F.col("_b")).cast("int") - 1)))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "resample", "_k")), 1, 8), 16, 10).cast("long")
    start = (u % (F.col("_n") - F.col("_b") + 1)).cast("int")
    size = F.least(F.col("_b"), F.col("_n") - F.col("_k") * F.col("_b"))
    draws = draws.select(*keys, "resample", "_n", start.alias("_a"), (start + size).alias("_z"))
    at = lambda c, s: p.select(*keys, F.col("_i").alias(c), F.col("_s").alias(s))
    both = draws.join(at("_z", "sz"), [*keys, "_z"]).join(at("_a", "sa"), [*keys, "_a"], "left")
    return both.groupBy(*keys, "resample").agg((F.sum(F.col("sz") - F.coalesce("sa", F.lit(0.0))) / F.max("_n")).alias("mean"))


def bootstrap_ci(means: DataFrame, keys: Sequence[str], level: float = 0.9) -> DataFrame:
    t = (1 - level) / 2
    return means.groupBy(*keys).agg(F.percentile("mean", F.lit(t)).alias("low"), F.percentile("mean", F.lit(1 - t)).alias("high"))


def paired_bootstrap(df: DataFrame, keys: Sequence[str], a: str, b: str, order: str, block: int, resamples: int, seed: int = 1) -> DataFrame:
    """(keys, n, mean_difference, low, high, p_not_better, p_two_sided) of paired losses a - b, resampled in blocks.

    ``p_not_better``: share of resampled means that are not below 0. ``p_two_sided``: share of resampled means that lie as far
    from the observed mean as that lies from 0 (the resamples centred on no difference).
    """
    d = df.withColumn("_d", F.col(a) - F.col(b)).filter(F.col("_d").isNotNull())
    own = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_difference"))
    x = block_bootstrap(d, keys, "_d", order, block, resamples, seed).join(own, list(keys))
    far = F.abs(F.col("mean") - F.col("mean_difference")) >= F.abs("mean_difference")
    return x.groupBy(*keys, "n", "mean_difference").agg(F.percentile("mean", F.lit(0.05)).alias("low"), F.percentile("mean", F.lit(0.95)).alias("high"), F.avg((F.col("mean") >= 0).cast("double")).alias("p_not_better"), F.avg(far.cast("double")).alias("p_two_sided"))


def psi(expected: DataFrame, actual: DataFrame, value: str, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability: quantile bins of the expected values, shares of at least 1e-6, outside values dropped."""
    edges = expected.groupBy(*by).agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(k / bins) for k in range(bins + 1)]))).alias("e"), F.count(value).alias("n0")).filter(F.col("n0") >= bins)

    def shares(d: DataFrame, out: str) -> DataFrame:
        e, v = F.col("e"), F.col(value)
        k = F.when(v == F.element_at(e, -1), F.size(e) - 1).otherwise(F.size(F.filter(e, lambda x: x <= v)))
        x = d.join(edges, list(by)).filter(v.between(F.element_at(e, 1), F.element_at(e, -1))).select(*by, k.alias("bin"))
        c = x.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("c"))
        return c.withColumn(out, F.col("c") / F.sum("c").over(W.partitionBy(*by))).drop("c")

    every = edges.filter(F.size("e") > 2).select(*by, F.explode(F.sequence(F.lit(1), F.size("e") - 1)).alias("bin"))
    both = every.join(shares(expected, "p"), [*by, "bin"], "left").join(shares(actual, "q"), [*by, "bin"], "left")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-6)) for c in ("p", "q"))
    found = both.groupBy(*by).agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    return edges.select(*by).join(found, list(by), "left").select(*by, F.coalesce("psi", F.lit(0.0)).alias("psi"))


def rank_candidates(scores: DataFrame, candidate: str = "candidate", score: str = "score", limit: float = 1.0) -> DataFrame:
    """mean, worst and deviation over folds, the selection score mean + 0.2 worst + 0.1 deviation, eligibility (below ``limit`` in
    every fold: for scores over the naive one, 1 means that it beats it always), and the place."""
    one = scores.groupBy(candidate).agg(F.avg(score).alias("mean"), F.max(score).alias("worst"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("dev"))
    one = one.withColumn("selection", F.col("mean") + 0.2 * F.col("worst") + 0.1 * F.col("dev"))
    one = one.withColumn("eligible", F.col("worst") < limit)
    return one.withColumn("place", F.row_number().over(W.orderBy("selection", candidate)))  # candidates are few


def dm_statistic(pred: DataFrame, by: Sequence[str], loss_a: str, loss_b: str, order: str, horizon: int = 1) -> DataFrame:
    """Diebold-Mariano: mean loss difference over its Bartlett long-run deviation, and the small-sample correction."""
    d = pred.withColumn("_d", F.col(loss_a) - F.col(loss_b))
    w = W.partitionBy(*by).orderBy(order)
    d = d.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, horizon)})
    lrv = F.var_samp("_d")
    for k in range(1, horizon):
        lrv = lrv + 2 * (1 - k / horizon) * F.covar_samp("_d", f"_l{k}")
    n = F.count("_d")
    out = d.groupBy(*by).agg(n.alias("n"), F.avg("_d").alias("mean_diff"), lrv.alias("lrv"))
    stat = F.col("mean_diff") / F.sqrt(F.when(F.col("lrv") > 0, F.col("lrv")) / F.col("n"))
    fix = F.sqrt((F.col("n") + 1 - 2 * horizon + horizon * (horizon - 1) / F.col("n")) / F.col("n"))
    return out.withColumns({"dm": stat, "dm_hln": stat * fix})


def _series_sum(first: int, last: Column, ratio) -> Column:
    """1 + r(first) + r(first) r(first+1) + ... up to the last index; 1 if there is none."""
    idx = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["sum"] + a["term"] * ratio(i)).alias("sum"))
    return F.aggregate(idx, start, step, lambda a: a["sum"])


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic, from the series of the error function (all of one sign); NULL stays NULL."""
    x = F.abs(z) / (2**0.5)
    erf = 2 / (F.pi() ** 0.5) * x * F.exp(-x * x) * _series_sum(1, F.lit(200), lambda i: 2 * x * x / (2 * i + 1))
    return F.when(F.abs(z) > 9, 0.0).when(z.isNotNull(), F.greatest(F.lit(0.0), 1 - erf))


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with a whole number of degrees of freedom, from its finite sum; NULL below one degree."""
    df, t = df.cast("int"), F.abs(t)
    cos2, sine = df / (df + t * t), t / F.sqrt(df + t * t)
    even = sine * _series_sum(1, F.floor((df - 2) / 2).cast("int"), lambda i: (2 * i - 1) / (2 * i) * cos2)
    odd = 2 / F.pi() * (F.atan(t / F.sqrt(df)) + F.when(df >= 3, sine * F.sqrt(cos2) * _series_sum(1, F.floor((df - 3) / 2).cast("int"), lambda i: 2 * i / (2 * i + 1) * cos2)).otherwise(0.0))
    return F.when((df >= 1) & t.isNotNull(), F.greatest(F.lit(0.0), 1 - F.when(df % 2 == 0, even).otherwise(odd)))


def dm_test(pred: DataFrame, by: Sequence[str], loss_a: str, loss_b: str, order: str, horizon: int = 1) -> DataFrame:
    """The statistics with ``p_normal`` and, for the corrected one, ``p_t`` with n - 1 degrees of freedom. A long-run variance that
    isn't positive tells nothing: both are 1."""
    x = dm_statistic(pred, by, loss_a, loss_b, order, horizon)
    none = F.col("lrv").isNotNull() & (F.col("lrv") <= 0)
    return x.withColumns({"p_normal": F.when(none, 1.0).otherwise(normal_p(F.col("dm"))), "p_t": F.when(none, 1.0).otherwise(t_p(F.col("dm_hln"), F.col("n") - 1))})


def spread_estimates(df: DataFrame, by: Sequence[str], spread: str, before: str, date: str = "date") -> DataFrame:
    """(n, kappa, se) per unit: how fast the spread returns, from its change on its last value, on rows before the date."""
    w = W.partitionBy(*by).orderBy(date)
    x = df.withColumns({"_x": F.lag(spread, 1).over(w), "_y": F.col(spread) - F.lag(spread, 1).over(w)}).filter(F.col(date) < F.lit(before).cast("date"))
    slope, sxx = F.regr_slope("_y", "_x"), F.regr_sxx("_y", "_x")
    rest = F.greatest(F.regr_syy("_y", "_x") - slope * slope * sxx, F.lit(0.0))
    return x.groupBy(*by).agg(F.count("_y").alias("n"), (-slope).alias("kappa"), F.sqrt(rest / F.nullif(F.count("_y") - 2, F.lit(0)) / F.nullif(sxx, F.lit(0.0))).alias("se"))


def pool_reversion(estimates: DataFrame, group: Sequence[str], unit: str, value: str = "kappa", se: str = "se") -> DataFrame:
    """Random-effects pooling (DerSimonian-Laird) and each unit's shrunk value; with fewer than three units its own."""
    ok = estimates.filter((F.col(se) > 0) & F.col(value).isNotNull())
    wgt = 1 / (F.col(se) * F.col(se))
    a = ok.groupBy(*group).agg(F.count(F.lit(1)).alias("units"), F.sum(wgt).alias("sw"), F.sum(wgt * F.col(value)).alias("swx"), F.sum(wgt * F.col(value) * F.col(value)).alias("swxx"), F.sum(wgt * wgt).alias("sww"))
    q = F.col("swxx") - F.col("swx") * F.col("swx") / F.col("sw")
    tau2 = F.greatest(F.lit(0.0), (q - (F.col("units") - 1)) / F.nullif(F.col("sw") - F.col("sww") / F.col("sw"), F.lit(0.0)))
    x = ok.join(a.select(*group, "units", F.coalesce(tau2, F.lit(0.0)).alias("tau2")), list(group))
    r = 1 / (F.col(se) * F.col(se) + F.col("tau2"))
    pooled = x.groupBy(*group).agg((F.sum(r * F.col(value)) / F.sum(r)).alias("pooled"))
    x = x.join(pooled, list(group))
    own = F.col("tau2") / F.nullif(F.col("tau2") + F.col(se) * F.col(se), F.lit(0.0))
    return x.withColumn("shrunk", F.when(F.col("units") < 3, F.col(value)).otherwise(own * F.col(value) + (1 - own) * F.col("pooled"))).select(*group, unit, value, se, "tau2", "pooled", "shrunk")


def usage_summary(events: DataFrame, tenant: str, status: str, latency: str, period: Column, quota: int) -> DataFrame:
    """Calls, errors (status >= 400), mean latency, what is left of the quota, and the share of it that is used, per tenant and period."""
    x = events.withColumn("period", period).groupBy(tenant, "period").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col(status) >= 400, 1)).alias("errors"), F.avg(latency).alias("mean_latency"))
    return x.withColumns({"left": F.greatest(F.lit(quota) - F.col("calls"), F.lit(0)), "used": F.col("calls") / F.nullif(F.lit(quota), F.lit(0)), "exceeded": F.col("calls") > quota})


def usage_by_path(events: DataFrame, tenant: str, path: str, period: Column) -> DataFrame:
    """Calls per tenant, period and path."""
    return events.withColumn("period", period).groupBy(tenant, "period", path).agg(F.count(F.lit(1)).alias("calls"))


def peak_calls(events: DataFrame, tenant: str, at: Column, period: Column, seconds: int = 60) -> DataFrame:
    """The most calls of a tenant within any trailing minute that ends in the period."""
    w = W.partitionBy(tenant).orderBy("_at").rangeBetween(1 - seconds, 0)
    x = events.select(tenant, period.alias("period"), F.unix_timestamp(at.cast("timestamp")).alias("_at"))
    return x.withColumn("_n", F.count(F.lit(1)).over(w)).groupBy(tenant, "period").agg(F.max("_n").alias("peak"))


def prebuy_replay(pred: DataFrame, keys: Sequence[str], horizon: int, liters: float, share: float, threshold: float, carry: float, date: str = "target_date") -> DataFrame:
    """Events where the forecast exceeds the origin by the threshold at least: what buying early saved."""
    hit = pred.filter(F.col("prediction") - F.col("origin") >= threshold)
    volume = liters * share
    return hit.withColumns({"volume": F.lit(volume), "saving": volume * (F.col("actual") - F.col("origin") - carry * horizon), "right": (F.col("actual") > F.col("origin"))})


def replay_summary(pred: DataFrame, keys: Sequence[str], horizon: int, liters: float, share: float, threshold: float, carry: float, means: DataFrame | None = None) -> DataFrame:
    """The replay over all weeks, those without a trigger included.

    (keys, weeks, triggers, precision, total, gross_profit, gross_loss, return_on_spend, annualised, largest_share, off_calendar);
    spend is the demand of every week at its origin price; ``precision``: share of triggers after which the price rose;
    ``off_calendar``: rows whose target is not ``horizon`` weeks after the origin. With the resampled means of the weekly savings
    (``means``), also the 90 % interval of the annualised value.
    """
    x = weekly_savings(pred, horizon, liters, share, threshold, carry)
    s, hit = F.col("saving"), F.col("trigger")
    total = F.sum(s)
    one = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("weeks"), F.count(F.when(hit, 1)).alias("triggers"), F.avg(F.when(hit, (F.col("actual") > F.col("origin")).cast("double"))).alias("precision"), total.alias("total"),
        F.sum(F.greatest(s, F.lit(0.0))).alias("gross_profit"), F.sum(F.greatest(-s, F.lit(0.0))).alias("gross_loss"), (total / F.nullif(F.sum(liters * F.col("origin")), F.lit(0.0))).alias("return_on_spend"),
        (F.avg(s) * 52).alias("annualised"), F.when(total > 0, F.max(s) / total).alias("largest_share"), F.count(F.when(F.datediff("target_date", "date") != 7 * horizon, 1)).alias("off_calendar"),
    )
    if means is None:
        return one
    ci = bootstrap_ci(means, keys).select(*keys, (F.col("low") * 52).alias("annual_low"), (F.col("high") * 52).alias("annual_high"))
    return one.join(ci, list(keys), "left")


def weekly_savings(pred: DataFrame, horizon: int, liters: float, share: float, threshold: float, carry: float) -> DataFrame:
    """``trigger`` and ``saving`` of every row: 0 where nothing is bought early."""
    hit = F.coalesce(F.col("prediction") - F.col("origin") >= threshold, F.lit(False))
    return pred.withColumns({"trigger": hit, "saving": F.when(hit, liters * share * (F.col("actual") - F.col("origin") - carry * horizon)).otherwise(0.0)})


def profitability(events: DataFrame, by: Sequence[str], saving: str = "saving", spend: str | None = None, weeks: str | None = None) -> DataFrame:
    """Win rate over triggers, profit factor (infinite without a loss), gross profit and loss, expectancy, largest event's share (NULL unless
    the total is positive); with columns of spend and weeks also the return on spend and the value a year."""
    s = F.col(saving)
    up, down = F.sum(F.when(s > 0, s).otherwise(0.0)), -F.sum(F.when(s < 0, s).otherwise(0.0))
    total = F.sum(s)
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("triggers"), total.alias("total"), F.avg((s > 0).cast("double")).alias("win_rate"), F.when(down > 0, up / down).when(up > 0, F.lit(float("inf"))).alias("profit_factor"), F.avg(s).alias("expectancy"), F.when(total > 0, F.max(s) / total).alias("largest_share"), up.alias("gross_profit"), down.alias("gross_loss"),
        *([(total / F.nullif(F.sum(spend), F.lit(0.0))).alias("return_on_spend")] if spend else []), *([(52 * total / F.nullif(F.sum(weeks), F.lit(0))).alias("annualised")] if weeks else []))


def stratified_sample(df: DataFrame, strata: Sequence[str], ident: str, n: int, seed: int) -> DataFrame:
    """n rows with quotas by stratum size (largest remainders), lowest sha256 of 'seed:id' first."""
    size = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("m"))
    total = size.agg(F.sum("m").alias("t"))
    q = size.join(F.broadcast(total), how="cross").withColumn("exact", n * F.col("m") / F.col("t")).withColumn("base", F.floor("exact"))  # the total is one row
    q = q.withColumn("given", F.sum("base").over(W.partitionBy(F.lit(1)))).withColumn("_r", F.row_number().over(W.orderBy(F.desc(F.col("exact") - F.col("base")), *strata)))  # strata are few
    q = q.select(*strata, (F.col("base") + (F.col("_r") <= n - F.col("given")).cast("int")).alias("quota"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")), 256)
    ranked = df.join(q, list(strata)).withColumn("_k", F.row_number().over(W.partitionBy(*strata).orderBy(key)))
    return ranked.filter((F.col("_k") <= n) & (F.col("_k") <= F.col("quota"))).drop("_k", "quota")


def weekly_reduce(df: DataFrame, keys: Sequence[str], date: str, value: str, how: str = "mean") -> DataFrame:
    """Values by the Sunday that ends their week: 'mean', 'median', or 'preserve' (then two rows in a week are an error)."""
    end = F.date_add(F.to_date(F.date_trunc("week", date)), 6)
    x = df.select(*keys, end.alias("week_end"), value).dropna().groupBy(*keys, "week_end")
    if how == "preserve":
        one = F.when(F.count(value) == 1, F.max(value)).otherwise(F.raise_error(F.lit("several rows in a week")).cast("double"))
        return x.agg(one.alias(value))
    return x.agg((F.avg(value) if how == "mean" else F.median(value)).alias(value))


def summary_gate(df: DataFrame, by: Sequence[str], value: str, expected: DataFrame, tolerance: float) -> DataFrame:
    """(measure, found, expected, ok) for n, mean, std, min, q1, median, q3, max; ``expected`` has (by, measure, expected)."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    one = df.groupBy(*by).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"), q.alias("_q"))
    one = one.withColumns({"q1": F.col("_q")[0], "median": F.col("_q")[1], "q3": F.col("_q")[2]}).drop("_q")
    long = one.unpivot(list(by), ["n", "mean", "std", "min", "q1", "median", "q3", "max"], "measure", "found")
    x = long.join(expected, [*by, "measure"], "left")
    return x.withColumn("ok", F.coalesce(F.abs(F.col("found") - F.col("expected")) <= tolerance, F.lit(False)))


def classification_report(df: DataFrame, by: Sequence[str], truth: str, probs: dict[int, str], no_news: Column | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1, Brier, log loss and calibration error (bins (lo, lo + 0.1]) of class probabilities, and the
    share of rows without news.

    The class of the largest probability is predicted; at equal ones the first named. Classes that never occur count as NULL
    in the means over classes. Two aggregations, then one row per group and class.
    """
    d = df.dropna(subset=[truth, *probs.values()])
    top = F.greatest(*probs.values())
    guess = F.coalesce(*[F.when(F.col(p) == top, F.lit(c)) for c, p in probs.items()])
    own = F.coalesce(*[F.when(F.col(truth) == c, F.col(p)) for c, p in probs.items()])
    brier = sum(((F.col(p) - (F.col(truth) == c).cast("double")) * (F.col(p) - (F.col(truth) == c).cast("double")) for c, p in probs.items()), F.lit(0.0))
    d = d.withColumns({"_g": guess, "_hit": (guess == F.col(truth)).cast("double"), "_top": top, "_ll": -F.log(F.greatest(own, F.lit(1e-15))), "_br": brier})
    quiet = F.avg(F.coalesce(no_news, F.lit(False)).cast("double")) if no_news is not None else F.lit(0.0)
    whole = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("accuracy"), F.avg("_br").alias("brier"), F.avg("_ll").alias("log_loss"), quiet.alias("no_news_rate"),
        *[x for c in probs for x in (F.count(F.when(F.col(truth) == c, 1)).alias(f"_t{c}"), F.count(F.when(F.col("_g") == c, 1)).alias(f"_p{c}"), F.count(F.when((F.col(truth) == c) & (F.col("_g") == c), 1)).alias(f"_b{c}"))])
    mean = lambda cs: F.aggregate(F.filter(F.array(*cs), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(F.filter(F.array(*cs), lambda x: x.isNotNull())), F.lit(0))
    recall = [F.col(f"_b{c}") / F.nullif(F.col(f"_t{c}"), F.lit(0)) for c in probs]
    f1 = [2 * F.col(f"_b{c}") / F.nullif(F.col(f"_t{c}") + F.col(f"_p{c}"), F.lit(0)) for c in probs]
    whole = whole.select(*by, "n", "accuracy", mean(recall).alias("balanced_accuracy"), mean(f1).alias("macro_f1"), "brier", "log_loss", "no_news_rate")
    bins = d.groupBy(*by, F.ceil(F.col("_top") * 10).alias("_bin")).agg(F.count(F.lit(1)).alias("m"), F.abs(F.avg("_hit") - F.avg("_top")).alias("gap"))
    ece = bins.groupBy(*by).agg((F.sum(F.col("m") * F.col("gap")) / F.sum("m")).alias("ece"))
    return whole.join(ece, list(by)) if by else whole.join(ece, how="cross")  # one row each


def quintile_study(df: DataFrame, by: Sequence[str], x: str, y: str, threshold: float) -> DataFrame:
    """Correlation, and the mean and event rate (|y| > threshold) of y in the lowest and the highest fifth of x."""
    d = df.dropna(subset=[x, y])
    cut = d.groupBy(*by).agg(F.percentile(x, F.array(F.lit(0.2), F.lit(0.8))).alias("_q"))
    d = d.join(cut, list(by))
    low, high, event = F.col(x) <= F.col("_q")[0], F.col(x) >= F.col("_q")[1], (F.abs(y) > threshold).cast("double")
    return d.groupBy(*by).agg(F.corr(x, y).alias("corr"), F.avg(F.when(low, F.col(y))).alias("low_mean"), F.avg(F.when(high, F.col(y))).alias("high_mean"), F.avg(F.when(low, event)).alias("low_events"), F.avg(F.when(high, event)).alias("high_events"))


def residual_redundancy(df: DataFrame, by: Sequence[str], a: str, b: str, without: Sequence[int] = (1, 3, 5), tail: float = 0.9) -> DataFrame:
    """How alike two residual series are: Pearson, Spearman (mean ranks), Pearson without the largest |a|, share of tail rows shared."""
    d = df.dropna(subset=[a, b])

    def rank(c: str) -> Column:
        w = W.partitionBy(*by)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*by, c)) - 1) / 2

    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.abs(a)), a, b))
    d = d.withColumns({"_ra": rank(a), "_rb": rank(b), "_i": place})
    cut = d.groupBy(*by).agg(F.percentile(F.abs(a), F.lit(tail)).alias("_ca"), F.percentile(F.abs(b), F.lit(tail)).alias("_cb"))
    d = d.join(cut, list(by))
    in_a, in_b = F.abs(a) >= F.col("_ca"), F.abs(b) >= F.col("_cb")
    return d.groupBy(*by).agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"), *[F.corr(F.when(F.col("_i") > k, F.col(a)), F.when(F.col("_i") > k, F.col(b))).alias(f"pearson_without_{k}") for k in without],
        (F.count(F.when(in_a & in_b, 1)) / F.nullif(F.count(F.when(in_a, 1)), F.lit(0))).alias("tail_dependence"))


def best_per_group(df: DataFrame, group: Sequence[str], metric: str, name: str) -> DataFrame:
    """The row of the least metric per group; ties by name."""
    return df.groupBy(*group).agg(F.min(F.struct(F.col(metric), F.col(name))).alias("_x")).select(*group, "_x.*")


def direction_probs(df: DataFrame, by: Sequence[str], resid: str, yhat: str, now: str, order: str, band: float, window: int = 104, at_least: int = 20) -> DataFrame:
    """P(up), P(flat), P(down) at each key's last row, from its last residuals moved to the forecast; NULL with too few.

    Each key's residuals are aggregated against its own last forecast: no pairs of rows.
    """
    w = W.partitionBy(*by).orderBy(F.desc(order))
    x = df.withColumns({"_i": F.row_number().over(w), "_h": F.first(yhat).over(w), "_n": F.first(now).over(w)}).filter((F.col("_i") <= window) & F.col(resid).isNotNull())
    move = F.col("_h") + F.col(resid) - F.col("_n")
    share = lambda c: F.when(F.count(F.lit(1)) >= at_least, F.avg(c.cast("double")))
    return x.groupBy(*by).agg(share(move > band).alias("up"), share(F.abs(move) <= band).alias("flat"), share(move < -band).alias("down"))


def convex_weights(df: DataFrame, by: Sequence[str], models: Sequence[str], actual: str, resolution: int = 10) -> DataFrame:
    """Weights on the simplex grid that minimise the mean absolute error of the blend; the first minimum in grid order wins.

    The grid is an array in each row (its size depends on resolution and models alone), so sums are combined before the shuffle.
    """
    grid = [[]]
    for m in range(len(models) - 1):
        grid = [[*g, k] for g in grid for k in range(resolution + 1 - sum(g))]
    grid = [[*g, resolution - sum(g)] for g in grid]
    d = df.dropna(subset=[actual, *models])
    blend = lambda g: sum((k / resolution * F.col(m) for k, m in zip(g, models)), F.lit(0.0))
    one = d.groupBy(*by).agg(F.array(*[F.struct(F.round(F.avg(F.abs(blend(g) - F.col(actual))), 9).alias("mae"), F.lit(i).alias("place"), F.array(*[F.lit(k / resolution) for k in g]).alias("w")) for i, g in enumerate(grid)]).alias("_g"))
    best = F.array_min("_g")
    return one.select(*by, best["mae"].alias("mae"), *[best["w"][i].alias(f"w_{m}") for i, m in enumerate(models)])


def permutation_importance(
    df: DataFrame, by: Sequence[str], weights: dict[str, float] | Sequence[str], target: str, ident: str, repeats: int = 3, seed: int = 1,
    scorer: Callable[[pd.DataFrame], np.ndarray] | None = None,
) -> DataFrame:
    """Rise of a scorer's squared error when one column is shuffled within its group, mean over repeats.

    The scorer is linear, by ``weights``; or a callable, which gets the columns that ``weights`` names as a batch of rows and
    returns a number for each (Spark hands it Arrow batches of rows of any groups). Shuffling pairs the rows in order of ``ident``
    with those in order of md5('seed|repeat|ident').
    """
    if scorer is None:
        score = lambda c: sum((w * F.col(c.get(k, k)) for k, w in weights.items()), F.lit(0.0))
    else:
        scored = F.pandas_udf(lambda rows: pd.Series(np.asarray(scorer(rows), float).ravel()), "double")
        score = lambda c: scored(F.struct(*[F.col(c.get(k, k)).alias(k) for k in weights]))
    sq = lambda c: F.pow(score(c) - F.col(target), 2)
    base = df.withColumn("_e", sq({})).groupBy(*by).agg(F.avg("_e").alias("_base"))
    x = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    group = W.partitionBy(*by, "repeat")
    key = F.md5(F.concat_ws("|", F.lit(seed), "repeat", ident))
    plain = x.withColumn("_i", F.row_number().over(group.orderBy(ident)))
    mixed = x.select(*by, "repeat", *[F.col(k).alias(f"_m_{k}") for k in weights], F.row_number().over(group.orderBy(key)).alias("_i"))
    both = plain.join(mixed, [*by, "repeat", "_i"])
    both = both.select(*by, *[sq({k: f"_m_{k}"}).alias(f"_e_{k}") for k in weights])
    one = both.groupBy(*by).agg(*[F.avg(f"_e_{k}").alias(k) for k in weights]).join(base, list(by))
    return one.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), (F.col(k) - F.col("_base")).alias("importance")) for k in weights])).alias("x")).select(*by, "x.*")


def stacked_ensemble(pred: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted combination of long predictions (keys, model, prediction) with (model, weight); only models with a weight count."""
    x = pred.join(weights, "model").filter(F.col("prediction").isNotNull())
    return x.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("prediction")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("prediction"))


def evaluate_gates(pred: DataFrame, by: Sequence[str], means: DataFrame, savings: DataFrame, threshold: float, alpha: float = 0.2, most_share: float = 0.5, slack: float = 1.02) -> DataFrame:
    """(by, gate, passed) of a challenger (prediction, lower, upper) against an incumbent (incumbent, incumbent_lower, incumbent_upper),
    and of all gates together.

    ``means`` are the resampled means of the difference of absolute errors (see ``block_bootstrap``); the gate needs its 95 %
    quantile below 0. ``savings`` are those of the weekly savings; their 5 % quantile, a year, must be positive. Further gates: lower mean
    error, no regression in events or quiet weeks (within ``slack``), errors not concentrated in one row, coverage within ten points of
    1 - alpha, an interval score not above the incumbent's. NULL measures fail.
    """
    e, i, event = F.abs(F.col("prediction") - F.col("actual")), F.abs(F.col("incumbent") - F.col("actual")), F.abs(F.col("actual") - F.col("origin")) > threshold
    a = pred.groupBy(*by).agg(F.avg(e).alias("_e"), F.avg(i).alias("_i"), *[F.avg(F.when(m, v)).alias(n) for n, m, v in (("_ee", event, e), ("_ie", event, i), ("_eq", ~event, e), ("_iq", ~event, i))], (F.max(e * e) / F.nullif(F.sum(e * e), F.lit(0.0))).alias("_share"), coverage().alias("_cov"), F.avg(winkler(alpha)).alias("_w"), F.avg(winkler(alpha, "incumbent_lower", "incumbent_upper")).alias("_wi"))
    ci = means.groupBy(*by).agg(F.percentile("mean", F.lit(0.95)).alias("_hi"))
    year = savings.groupBy(*by).agg((52 * F.percentile("mean", F.lit(0.05))).alias("_year"))
    x = a.join(ci, list(by), "left").join(year, list(by), "left")
    gates = {"beats_incumbent": F.col("_e") < F.col("_i"), "difference_below_zero": F.col("_hi") < 0, "events": F.col("_ee") <= slack * F.col("_ie"), "quiet": F.col("_eq") <= slack * F.col("_iq"), "not_concentrated": F.col("_share") <= most_share, "calibrated": F.abs(F.col("_cov") - (1 - alpha)) <= 0.1, "annual_savings": F.col("_year") > 0, "interval_score": F.col("_w") <= F.col("_wi")}
    gates = {k: F.coalesce(v, F.lit(False)) for k, v in gates.items()}
    both = F.lit(True)
    for v in gates.values():
        both = both & v
    return x.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in {**gates, "all": both}.items()])).alias("g")).select(*by, "g.*")


def promotion_report(pred: DataFrame, by: Sequence[str], order: str, at_least: int = 26) -> DataFrame:
    """(n, ratio, ratio_naive, worst_ratio, dm, status): 'promote' if n, the error ratios against the incumbent and against the naive
    forecast (both <= 0.98), the worst 13-week ratio (<= 1.05) and the one-sided 5 % test all agree; 'collect' with too few rows; else 'hold'."""
    from .features import worst_rolling_ratio

    p = pred.withColumns({"_a": F.col("prediction") - F.col("actual"), "_b": F.col("incumbent") - F.col("actual")}).withColumns({"_la": F.col("_a") * F.col("_a"), "_lb": F.col("_b") * F.col("_b")})
    naive = F.col("naive") - F.col("actual")
    ratio = p.groupBy(*by).agg(F.sqrt(F.avg("_la") / F.nullif(F.avg("_lb"), F.lit(0.0))).alias("ratio"), F.sqrt(F.avg("_la") / F.nullif(F.avg(naive * naive), F.lit(0.0))).alias("ratio_naive"))
    dm = dm_statistic(p, by, "_la", "_lb", order).select(*by, "n", "dm")
    x = ratio.join(worst_rolling_ratio(p, by, "_a", "_b", date=order), list(by)).join(dm, list(by))
    good = (F.col("ratio") <= 0.98) & (F.col("ratio_naive") <= 0.98) & (F.col("worst_ratio") <= 1.05) & (F.col("dm") < -1.6448536269514722)
    return x.withColumn("status", F.when(F.col("n") < at_least, "collect").when(good, "promote").otherwise("hold"))
