"""Registered queries: cleaning rules, joins and folds, panel features; each with the SQL that says the same."""
from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.functions import prep
from weekloom.operators import align, features, score
from weekloom.plans.queries import COST, K, PANEL, PRED, cost, panel, predictions, query, rounded, table, with_cost

SPREAD = PANEL + ", nat AS (SELECT date, avg(price) AS nat FROM p GROUP BY 1), sp AS (SELECT p.k, p.date, p.price, p.stations, nat, price - nat AS spread FROM p JOIN nat ON nat.date = p.date)"


def spread(spark, d):
    """The panel with each date's mean over all series and the distance from it."""
    p = panel(spark, d)
    return p.join(p.groupBy("date").agg(F.avg("price").alias("nat")), "date").withColumn("spread", F.col("price") - F.col("nat"))


@query("SELECT p_partkey, CASE p_size WHEN 50 THEN 'S500' WHEN 1 THEN 'S10' END AS product FROM part")
def prj2_canonical_product(spark, d):
    text = F.concat(F.lit("Óleo Diesel S-"), (F.col("p_size") * 10).cast("string"))
    return table(spark, d, "part").select("p_partkey", prep.canonical_product(text).alias("product"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE upper(trim(c_mktsegment)) IN ('BUILDING', 'MACHINERY')")
def prj4_filter_products(spark, d):
    return prep.filter_products(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["building", "Machinery"])


@query("SELECT user_id, date, event_id, value FROM (SELECT user_id, ts::DATE AS date, event_id, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS i FROM events WHERE value > 0 AND ts IS NOT NULL) WHERE i = 1")
def prj5_clean_series(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), "event_id", "value")
    return prep.clean_series(e, ["user_id"], "date", ["value"], ["value"], ["event_id"])


@query(f"WITH {PANEL} SELECT k, date, CASE WHEN date <= DATE '2000-06-30' THEN price END AS price, date BETWEEN DATE '1997-01-06' AND DATE '1997-03-31' AS in_gap FROM p WHERE date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30'")
def prj6_gap_censor_window(spark, d):
    x = prep.date_window(panel(spark, d), "date", "1996-01-01", "2001-06-30")
    return prep.censor_after(prep.flag_gap(x, "date", "1997-01-06", "1997-03-31"), "date", "price", "2000-06-30").select("k", "date", "price", "in_gap")


@query(f"WITH {COST} SELECT k, date, round(price / 3.785411784 * stations, 4) AS parity, cost * stations AS brent_local, price - cost AS margin FROM x")
def prj8_import_parity(spark, d):
    x = prep.import_parity(with_cost(spark, d), "price", "cost", "stations", "price", "cost")
    return x.select("k", "date", F.round("parity", 4).alias("parity"), "brent_local", "margin")


@query(f"WITH {PANEL} SELECT 'span' AS rule, 0 AS violations UNION ALL SELECT 'sunday', 0 UNION ALL SELECT 'price', count(*) FILTER (NOT price / 50 BETWEEN 1 AND 30) FROM p UNION ALL SELECT 'stations', count(*) FILTER (stations < 1) FROM p UNION ALL SELECT 'one_row', coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM (SELECT date, stations, count(*) AS n FROM p GROUP BY 1, 2)")
def prj10_observation_rules(spark, d):
    p = panel(spark, d).select(F.date_sub("date", 1).alias("start"), F.date_add("date", 5).alias("end"), F.col("stations").alias("product"), (F.col("price") / 50).alias("price"), "stations")
    return prep.observation_rules(p, "start", "end", "product", "price", "stations")


@query(f"WITH {PANEL} SELECT k, date, price, n_regionkey AS region FROM p LEFT JOIN nation ON n_nationkey = k")
def prj12_region_of(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"))
    return prep.with_region(panel(spark, d).select("k", "date", "price"), "k", n)


@query(f"WITH {COST}, n AS (SELECT date, avg(price) AS nat FROM p GROUP BY 1) SELECT n.date, round(nat, 6) AS nat, cost FROM n JOIN c ON c.date = n.date")
def jn4_join_one_to_one(spark, d):
    nat = panel(spark, d).groupBy("date").agg(F.avg("price").alias("nat"))
    return align.join_one_to_one(nat, cost(spark, d), ["date"]).withColumn("nat", F.round("nat", 6))


@query(f"WITH {PRED} SELECT p.k, p.date, p.price, round(r.prediction, 6) AS prediction FROM p LEFT JOIN r ON r.k = p.k AND r.date = p.date")
def jn9_augment(spark, d):
    x = align.augment(panel(spark, d), predictions(spark, d), ["k", "date"], ["prediction"])
    return x.select("k", "date", "price", F.round("prediction", 6).alias("prediction"))


@query(f"WITH {PANEL}, w AS (SELECT k, date, price, datediff('day', date, DATE '2000-01-03') / 7 AS w FROM p) SELECT k, date, price, CASE WHEN date > DATE '2001-01-01' THEN 'prospective' WHEN date >= DATE '2000-01-03' THEN 'holdout' WHEN 3 - floor((w - 1) / 52.0) >= 1 THEN 'validation_' || (3 - floor((w - 1) / 52.0))::BIGINT ELSE 'development' END AS fold FROM w")
def jn11_pinned_folds(spark, d):
    return align.pinned_folds(panel(spark, d).select("k", "date", "price"), "2000-01-03", "2001-01-01", 52, 3)


@query(f"WITH {PANEL}, h AS (SELECT k, count(*) FILTER (date BETWEEN DATE '2000-01-03' AND DATE '2001-01-01') AS n FROM p WHERE k % 5 > 0 OR date < DATE '2000-12-01' OR date > DATE '2001-01-01' GROUP BY k) SELECT k, n, n = 53 AS complete FROM h")
def jn11_holdout_length(spark, d):
    """Some series miss the last weeks of the holdout."""
    p = panel(spark, d).filter("k % 5 > 0 or date < '2000-12-01' or date > '2001-01-01'").select("k", "date", "price")
    return align.holdout_length(align.pinned_folds(p, "2000-01-03", "2001-01-01", 52, 3), K, 53)


@query(f"WITH {PANEL}, l AS (SELECT k, date, lead(date, 2) OVER (PARTITION BY k ORDER BY date) AS target_date FROM p), f AS (SELECT year(date) AS fold_id, min(date) AS a, max(date) AS b FROM p GROUP BY 1), x AS (SELECT k, l.date, CASE WHEN datediff('day', DATE '1995-01-02', l.date) % 1001 = 0 THEN 1999 ELSE fold_id END AS fold_id FROM l JOIN f ON target_date BETWEEN a AND b), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) AS i FROM x) SELECT k, fold_id, count(*) AS n, max(i) - min(i) + 1 = count(*) AS contiguous FROM i GROUP BY 1, 2")
def jn12_fold_contiguity(spark, d):
    """Every 143rd week is put into a wrong fold."""
    p = panel(spark, d)
    folds = p.groupBy(F.year("date").alias("fold_id")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    x = align.remap_fold(align.lagged_dataset(p.drop("stations"), K, "price", [], 2), folds)
    wrong = F.datediff("date", F.lit("1995-01-02").cast("date")) % 1001 == 0
    return align.fold_contiguity(x.withColumn("fold_id", F.when(wrong, 1999).otherwise(F.col("fold_id"))), K)


@query(f"WITH {PANEL}, l AS (SELECT k, date, lead(date, 2) OVER (PARTITION BY k ORDER BY date) AS target_date FROM p), f AS (SELECT year(date) AS fold_id, min(date) AS a, max(date) AS b FROM p GROUP BY 1) SELECT k, l.date, target_date, fold_id FROM l JOIN f ON target_date BETWEEN a AND b WHERE datediff('day', l.date, target_date) = 14")
def jn12_remap_fold(spark, d):
    p = panel(spark, d)
    pairs = align.exact_week_pairs(align.lagged_dataset(p.drop("stations"), K, "price", [], 2), 2, "date", "target_date")
    folds = p.groupBy(F.year("date").alias("fold_id")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    return align.remap_fold(pairs, folds).select("k", "date", "target_date", "fold_id")


@query(f"WITH {PANEL}, s AS (SELECT p.*, n_regionkey AS region FROM p JOIN nation ON n_nationkey = k), nat AS (SELECT date, round(avg(price), 6) AS national FROM p GROUP BY 1), pr AS (SELECT n_regionkey AS region, o_orderdate::DATE AS date, round(avg(o_totalprice), 6) AS producer FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), u AS (SELECT DISTINCT region, date FROM s), m AS (SELECT u.region, u.date, producer, row_number() OVER (PARTITION BY u.region, u.date ORDER BY abs(datediff('day', pr.date, u.date)), pr.date) AS i FROM u LEFT JOIN pr ON pr.region = u.region AND abs(datediff('day', pr.date, u.date)) <= 3) SELECT s.k, s.date, s.region, s.price, national, producer FROM s LEFT JOIN nat ON nat.date = s.date LEFT JOIN m ON m.region = s.region AND m.date = s.date AND i = 1")
def jn14_state_panels(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"))
    p = panel(spark, d)
    nat = p.groupBy("date").agg(F.round(F.avg("price"), 6).alias("national"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("k"))
    producer = o.groupBy("region", F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 6).alias("producer"))
    return align.state_panels(p.join(n, "k"), nat, producer, "region").select("k", "date", "region", "price", "national", "producer")


@query("WITH o AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1) SELECT * FROM o UNION ALL SELECT * FROM n ANTI JOIN o USING (month)")
def jn15_union_dedupe(spark, d):
    o = table(spark, d, "orders").withColumn("month", F.to_date(F.date_trunc("month", "o_orderdate")))
    count = lambda x: x.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    return align.union_dedupe(count(o.filter("o_orderstatus = 'F'")), count(o), ["month"])


@query(f"WITH {COST}, m AS (SELECT k, date, price, price - lag(price) OVER w AS dp, ln(cost) - ln(lag(cost) OVER w) AS c, lag(price) OVER w AS p1 FROM x WINDOW w AS (PARTITION BY k ORDER BY date)) SELECT k, date, round(dp, 6) AS dp, round(lag(dp) OVER w, 6) AS dp1, round(lag(c, 2) OVER w * p1, 4) AS cost_2, round(abs(c), 6) AS abs_cost, CASE WHEN count(dp) OVER v >= 12 THEN round(stddev_samp(dp) OVER v, 5) END AS vol26 FROM m WINDOW w AS (PARTITION BY k ORDER BY date), v AS (PARTITION BY k ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)")
def wf4_passthrough_panel(spark, d):
    x = features.passthrough_panel(with_cost(spark, d), K, "price", "cost")
    return x.select("k", "date", F.round("dp", 6).alias("dp"), F.round("dp1", 6).alias("dp1"), F.round("cost_2", 4).alias("cost_2"), F.round("abs_cost", 6).alias("abs_cost"), F.round("vol26", 5).alias("vol26"))


@query(f"WITH {COST}, y AS (SELECT k, date, price, stations, cost FROM x UNION ALL SELECT k, (max(date) + INTERVAL 7 DAY)::DATE, NULL, NULL, NULL FROM x GROUP BY k), m AS (SELECT *, price - lag(price) OVER w AS dp, ln(cost) - ln(lag(cost) OVER w) AS c, lag(price) OVER w AS p1 FROM y WINDOW w AS (PARTITION BY k ORDER BY date)) SELECT k, date, round(lag(dp) OVER w, 6) AS dp1, (lag(stations, 1) OVER w - lag(stations, 2) OVER w)::DOUBLE AS producer_move, round(lag(c) OVER w, 6) AS crude_move, round(lag(c, 2) OVER w * p1, 4) AS cost_2, CASE WHEN count(dp) OVER v >= 12 THEN round(stddev_samp(dp) OVER v, 5) END AS vol26 FROM m WINDOW w AS (PARTITION BY k ORDER BY date), v AS (PARTITION BY k ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)")
def wf5_parity_panel_next_week(spark, d):
    x = features.parity_panel(features.with_next_week(with_cost(spark, d), K), K, "price", "cost", "stations", crude="cost")
    return x.select("k", "date", F.round("dp1", 6).alias("dp1"), F.col("producer_move").cast("double").alias("producer_move"), F.round("crude_move", 6).alias("crude_move"), F.round("cost_2", 4).alias("cost_2"), F.round("vol26", 5).alias("vol26"))


@query(f"WITH {COST}, m AS (SELECT k, date, ln(lag(cost) OVER w) - ln(lag(price) OVER w) AS press FROM x WINDOW w AS (PARTITION BY k ORDER BY date)), z AS (SELECT *, count(press) OVER v AS n, avg(press) OVER v AS m, stddev_samp(press) OVER v AS s FROM m WINDOW v AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT k, date, round(press, 6) AS press, CASE WHEN n >= 52 THEN round((press - m) / s, 5) + 0.0 END AS press_z FROM z")
def wf7_pressure_features(spark, d):
    x = features.pressure_features(with_cost(spark, d), K, "price", "price", "cost")
    return x.select("k", "date", F.round("press", 6).alias("press"), (F.round("press_z", 5) + 0.0).alias("press_z"))


@query(f"WITH {SPREAD}, a AS (SELECT k, date, spread, lead(spread, 4) OVER (PARTITION BY k ORDER BY date) - spread AS f FROM sp), q AS (SELECT k, unnest([0.02, 0.05, 0.1])::DOUBLE AS share, unnest(quantile_cont(spread, [0.02, 0.05, 0.1])) AS cut FROM sp GROUP BY k), l AS (SELECT a.k, share, date, f, coalesce((datediff('day', lag(date) OVER (PARTITION BY a.k, share ORDER BY date), date) > 56)::INT, 1) AS n FROM a JOIN q ON q.k = a.k WHERE spread <= cut), la AS (SELECT k, arg_max(spread, date) AS s, avg(spread) AS m, stddev_samp(spread) AS sd FROM sp GROUP BY k), nw AS (SELECT la.k, (s - m) / sd AS z, avg((spread <= s)::INT::DOUBLE) AS pc FROM la JOIN sp ON sp.k = la.k GROUP BY ALL) SELECT l.k, share, count(*) AS weeks, sum(n)::BIGINT AS episodes, round(avg(f), 6) AS mean_forward, round(avg((f > 0)::INT::DOUBLE), 6) AS share_up, round(max(z), 6) AS z_now, round(max(pc), 6) AS percentile_now FROM l JOIN nw ON nw.k = l.k GROUP BY 1, 2")
def wf15_spread_opportunity(spark, d):
    return rounded(features.spread_opportunity(spread(spark, d), K, "spread", 4))


@query(f"WITH {SPREAD}, b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date DESC) AS i FROM sp), o AS (SELECT k, arg_max(price, date) AS price, arg_max(spread, date) AS spread, avg(abs(spread)) FILTER (i <= 52) AS m, avg(spread) AS a, stddev_samp(spread) AS s FROM b GROUP BY k) SELECT o.k, round(o.price, 6) AS price, round(o.spread, 6) AS spread, round(m, 6) AS mean_abs_spread, round((o.spread - a) / s, 6) AS z, round(avg((b.spread <= o.spread)::INT::DOUBLE), 6) AS percentile FROM o JOIN b ON b.k = o.k GROUP BY ALL")
def wf16_basis_report(spark, d):
    return rounded(features.basis_report(spread(spark, d), K, "price", "spread"))


EST = SPREAD + ", l AS (SELECT *, spread - lag(spread) OVER w AS d, lag(spread) OVER w AS s1 FROM sp WINDOW w AS (PARTITION BY k ORDER BY date)), es AS (SELECT k, count(d) AS n, -regr_slope(d, s1) AS kappa, sqrt(greatest(regr_syy(d, s1) - regr_slope(d, s1) ** 2 * regr_sxx(d, s1), 0) / (count(d) - 2) / regr_sxx(d, s1)) AS se FROM l WHERE date < DATE '2000-01-03' GROUP BY k)"


@query(f"WITH {EST} SELECT k, n, round(kappa, 6) AS kappa, round(se, 6) AS se FROM es")
def ml10_spread_estimates(spark, d):
    return rounded(score.spread_estimates(spread(spark, d), K, "spread", "2000-01-03"))


@query(f"WITH {EST}, e AS (SELECT n_regionkey AS region, k, kappa, se, 1 / se ** 2 AS w FROM es JOIN nation ON n_nationkey = k), a AS (SELECT region, count(*) AS u, greatest(0, coalesce((sum(w * kappa ** 2) - sum(w * kappa) ** 2 / sum(w) - (count(*) - 1)) / nullif(sum(w) - sum(w * w) / sum(w), 0), 0)) AS t FROM e GROUP BY 1), q AS (SELECT e.*, u, t, sum(kappa / (se ** 2 + t)) OVER (PARTITION BY e.region) / sum(1 / (se ** 2 + t)) OVER (PARTITION BY e.region) AS p FROM e JOIN a ON a.region = e.region) SELECT region, k, round(p, 5) AS pooled, round(CASE WHEN u < 3 THEN kappa ELSE t / (t + se ** 2) * kappa + se ** 2 / (t + se ** 2) * p END, 5) AS shrunk FROM q")
def ag18_pool_reversion(spark, d):
    e = score.spread_estimates(spread(spark, d), K, "spread", "2000-01-03")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"))
    return rounded(score.pool_reversion(e.join(n, "k"), ["region"], "k").select("region", "k", "pooled", "shrunk"), 5)
