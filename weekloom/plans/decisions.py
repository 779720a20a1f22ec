"""Registered queries: decisions; each with the SQL that says the same."""
from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.functions.prep import LITRES_PER_GALLON
from weekloom.operators import decide, features
from weekloom.plans.alignment import SPREAD, spread
from weekloom.plans.queries import COST, K, PANEL, PRED, banded, panel, predictions, query, rounded, table, with_cost


def volumes(spark, d):
    """(k, customer, volume, scope): customers of each nation; building firms buy in their state only."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("customer"), F.round(F.abs("c_acctbal"), 2).alias("volume"), F.when(F.col("c_mktsegment") == "BUILDING", "state").otherwise("national").alias("scope"))


VOL = "v AS (SELECT c_nationkey AS k, c_custkey AS customer, round(abs(c_acctbal), 2) AS volume, CASE WHEN c_mktsegment = 'BUILDING' THEN 'state' ELSE 'national' END AS scope FROM customer)"
LAST = PRED + f", {VOL}, z AS (SELECT k, max(target_date) AS target_date FROM r GROUP BY k), la AS (SELECT r.k, r.target_date, r.origin, r.prediction FROM r JOIN z ON z.k = r.k AND z.target_date = r.target_date)"


def latest(spark, d):
    """Each key's forecast for its last target week."""
    p = predictions(spark, d)
    return p.groupBy("k").agg(F.max(F.struct("target_date", "origin", "prediction", "actual")).alias("x")).select("k", "x.*")


@query(f"WITH {PRED}, n AS (SELECT *, coalesce((datediff('day', lag(date) OVER (PARTITION BY k ORDER BY date), date) <> 7)::INT, 1) AS n FROM r), b AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM n), c AS (SELECT *, count(*) OVER (PARTITION BY k, block) AS c FROM b), e AS (SELECT k, block, 100.0 * (actual - origin - 1.5) AS s FROM c WHERE c >= 3 AND prediction - origin >= 5) SELECT k, block, count(*) AS triggers, round(sum(s), 1) AS total, round(avg((s > 0)::INT::DOUBLE), 6) AS win_rate FROM e GROUP BY 1, 2")
def dc2_block_replay(spark, d):
    x = decide.block_replay(predictions(spark, d), K, 1, 1000.0, 0.1, 5.0, 1.5)
    return x.select("k", "block", "triggers", F.round("total", 1).alias("total"), F.round("win_rate", 6).alias("win_rate"))


@query(f"WITH {LAST}, ch AS (SELECT p.k, p.date AS target_date, avg(q.price) AS challenger FROM p JOIN p q ON q.date = p.date - INTERVAL 7 DAY GROUP BY 1, 2), x AS (SELECT la.*, challenger, prediction - origin AS rise, sign(prediction - origin) = sign(challenger - origin) AS agreement FROM la LEFT JOIN ch ON ch.k = la.k AND ch.target_date = la.target_date) SELECT customer, x.k, CASE WHEN rise > 10 THEN 'buy_early' ELSE 'wait' END AS recommend, round(CASE WHEN rise > 10 THEN volume * 0.3 ELSE 0 END, 4) AS liters, round(CASE WHEN rise > 10 THEN volume * 0.3 ELSE 0 END * rise, 2) AS saving, agreement, CASE WHEN agreement IS NULL OR NOT agreement THEN 'low' WHEN scope = 'state' THEN 'medium' ELSE 'high' END AS confidence FROM x JOIN v ON v.k = x.k")
def dc3_decide(spark, d):
    p = panel(spark, d)
    nat = p.groupBy("date").agg(F.avg("price").alias("challenger")).withColumn("target_date", F.date_add("date", 7))
    ch = p.select("k", F.col("date").alias("target_date")).join(nat.drop("date"), "target_date")
    x = decide.decide(latest(spark, d), ch, volumes(spark, d), ["k", "target_date"], 10.0, 0.3)
    return x.select("customer", "k", "recommend", F.round("liters", 4).alias("liters"), F.round("saving", 2).alias("saving"), "agreement", "confidence")


@query(f"WITH {LAST} SELECT customer, v.k, round(volume * origin, 2) AS current_cost, round(volume * prediction, 2) AS forecast_cost, round(volume * (origin - 40), 2) AS low_cost, round(volume * (origin + 50), 2) AS high_cost FROM la JOIN v ON v.k = la.k")
def dc4_cost_scenario(spark, d):
    f = latest(spark, d).withColumns({"lower": F.col("origin") - 40, "upper": F.col("origin") + 50})
    return rounded(decide.cost_scenario(f, volumes(spark, d), K).select("customer", "k", "current_cost", "forecast_cost", "low_cost", "high_cost"), 2)


@query(f"WITH {SPREAD}, {VOL}, b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date DESC) AS i FROM sp), o AS (SELECT k, arg_max(spread, date) AS spread, avg(abs(spread)) FILTER (i <= 52) AS m FROM b GROUP BY k) SELECT customer, v.k, round(volume * 52 * m, 2) AS budget_error, round(volume * 52 * spread, 2) AS current_gap FROM o JOIN v ON v.k = o.k")
def dc5_basis_cost(spark, d):
    b = features.basis_report(spread(spark, d), K, "price", "spread")
    return rounded(decide.basis_cost(b, volumes(spark, d), K).select("customer", "k", "budget_error", "current_gap"), 2)


GATED = COST + ", m AS (SELECT k, date, ln(lag(cost) OVER w) - ln(lag(price) OVER w) AS press FROM x WINDOW w AS (PARTITION BY k ORDER BY date)), z AS (SELECT k, date, CASE WHEN count(press) OVER v >= 52 THEN (press - avg(press) OVER v) / stddev_samp(press) OVER v END AS z FROM m WINDOW v AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"WITH {GATED}{PRED[len(PANEL):]} SELECT r.k, r.date, round(CASE WHEN z < 0 THEN prediction ELSE origin END / 3.785411784, 6) AS gated_litre FROM r LEFT JOIN z ON z.k = r.k AND z.date = r.date")
def dc6_gate_by_pressure(spark, d):
    press = features.pressure_features(with_cost(spark, d), K, "price", "price", "cost")
    return decide.gate_by_pressure(predictions(spark, d), press, ["k", "date"]).select("k", "date", F.round(F.col("gated") / LITRES_PER_GALLON, 6).alias("gated_litre"))


@query(f"WITH {PANEL}, m AS (SELECT *, avg(price) OVER (PARTITION BY k ORDER BY date ROWS 3 PRECEDING) AS m FROM p), h AS (SELECT unnest([1, 4, 12]) AS horizon) SELECT m.k, horizon, count(t.price) AS n, round(avg(abs(m.m - t.price)), 6) AS mae, round(avg(abs(m.m - t.price)) / avg(abs(m.price - t.price)), 6) AS ratio, count(*) FILTER (t.price IS NOT NULL AND m.m - m.price >= 5) AS triggers, round(coalesce(sum(t.price - m.price - 1.5 * horizon) FILTER (t.price IS NOT NULL AND m.m - m.price >= 5), 0), 4) AS saving, CASE WHEN count(t.price) = 0 THEN 'unavailable' ELSE 'available' END AS status FROM m CROSS JOIN h LEFT JOIN p t ON t.k = m.k AND t.date = m.date + INTERVAL 7 DAY * horizon GROUP BY 1, 2")
def dc7_horizon_sweep(spark, d):
    x = decide.horizon_sweep(panel(spark, d), K, "price", [1, 4, 12], threshold=5.0, carry=1.5)
    return rounded(x.withColumn("saving", F.round("saving", 4)))


@query(f"WITH {PANEL}, l AS (SELECT k, max(date) AS target FROM p GROUP BY k), t AS (SELECT max(date) + 7 AS today FROM p), s AS (SELECT k, target, greatest(datediff('day', target, today) - 6, 0) AS stale FROM l, t) SELECT k, target, stale, CASE WHEN stale = 0 THEN 'healthy' WHEN stale <= 14 THEN 'degraded' ELSE 'blocked' END AS status FROM s")
def dc8_freshness_status(spark, d):
    p = panel(spark, d)
    x = p.groupBy("k").agg(F.max("date").alias("target")).join(p.agg(F.date_add(F.max("date"), 7).alias("today")), how="cross")  # one row
    status, stale = decide.freshness(F.col("target"), F.col("today"))
    return x.select("k", "target", stale.alias("stale"), status.alias("status"))


@query(f"WITH {PRED}, g AS (SELECT *, datediff('day', lag(date) OVER (PARTITION BY k ORDER BY date), date) AS gap FROM r), o AS (SELECT k, count(*) AS n, avg((actual BETWEEN origin - 40 AND origin + 50)::INT::DOUBLE) AS coverage, avg(abs(prediction - actual)) AS mae, avg(abs(origin - actual)) AS b, count(*) FILTER (gap <> 7) AS missed, arg_max(abs(prediction - origin) / 400, date) AS cl, arg_max(abs(actual - origin) / 400, date) AS ca, arg_max(abs(actual - prediction) / 2000, date) AS ch FROM g GROUP BY k) SELECT k, n, round(coverage, 6) AS coverage, round(mae, 6) AS mae, missed, concat_ws(',', CASE WHEN n >= 20 AND coverage < 0.7 THEN 'coverage' END, CASE WHEN n >= 20 AND mae > b THEN 'mae' END, CASE WHEN missed > 0 THEN 'cadence' END, CASE WHEN cl > 0.25 THEN 'clip' END, CASE WHEN ca >= 0.9 THEN 'capacity' END, CASE WHEN ch >= 0.1 THEN 'churn' END) AS alerts FROM o")
def ml21_health_report(spark, d):
    """Clip, capacity and churn are stood in for by sizes of the last row's moves."""
    gap = lambda a, b, n: F.abs(F.col(a) - F.col(b)) / n
    x = banded(spark, d).withColumns({"clip": gap("prediction", "origin", 400), "capacity": gap("actual", "origin", 400), "churn": gap("actual", "prediction", 2000)})
    return rounded(decide.health_report(x, K, clip="clip", capacity="capacity", churn="churn"))
