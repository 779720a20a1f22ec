"""Registered queries: aggregation, scoring, tests and ranking; each with the SQL that says the same."""
from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import features, score
from weekloom.plans.queries import K, PANEL, PRED, panel, predictions, query, rounded, table


@query("SELECT user_id, (date_trunc('week', ts) + INTERVAL 6 DAY)::DATE AS week_end, round(median(value), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def ag1_weekly_reduce(spark, d):
    return rounded(score.weekly_reduce(table(spark, d, "events"), ["user_id"], "ts", "value", "median"))


@query("WITH s AS (SELECT event_type, unnest(['n', 'mean', 'std', 'min', 'q1', 'median', 'q3', 'max']) AS measure, unnest([count(value)::DOUBLE, avg(value), stddev_samp(value), min(value), quantile_cont(value, 0.25), median(value), quantile_cont(value, 0.75), max(value)]) AS found FROM events GROUP BY 1), x AS (SELECT avg(value) AS m FROM events) SELECT event_type, measure, round(found, 5) AS found, round(CASE WHEN measure = 'mean' THEN m END, 5) AS expected, coalesce(measure = 'mean' AND abs(found - m) <= 0.5, false) AS ok FROM s, x")
def ag2_summary_gate(spark, d):
    e = table(spark, d, "events")
    expected = e.select("event_type").distinct().join(e.agg(F.avg("value").alias("expected")), how="cross").withColumn("measure", F.lit("mean"))  # one row
    return rounded(score.summary_gate(e, ["event_type"], "value", expected, 0.5), 5)


CLASS = PRED + ", c AS (SELECT k, date, CASE WHEN actual > origin + 300 THEN 1 WHEN actual < origin - 300 THEN -1 ELSE 0 END AS y, 0.1 + 0.7 / (1 + exp(-(prediction - origin) / 200)) AS up, 0.1 + 0.7 / (1 + exp((prediction - origin) / 200)) AS down FROM r), b AS (SELECT *, 1 - up - down AS flat FROM c)"


@query(f"WITH {CLASS}, g AS (SELECT *, greatest(up, flat, down) AS top, CASE WHEN up >= flat AND up >= down THEN 1 WHEN flat >= down THEN 0 ELSE -1 END AS g, CASE y WHEN 1 THEN up WHEN 0 THEN flat ELSE down END AS own FROM b), n AS (SELECT k, count(*) AS n, avg((g = y)::INT::DOUBLE) AS accuracy, avg((up - (y = 1)::INT) ** 2 + (flat - (y = 0)::INT) ** 2 + (down - (y = -1)::INT) ** 2) AS brier, avg(-ln(greatest(own, 1e-15))) AS log_loss, avg((abs(up - down) < 0.01)::INT::DOUBLE) AS nn FROM g GROUP BY k), l AS (SELECT k, c, count(*) FILTER (y = c) AS t, count(*) FILTER (g = c) AS p, count(*) FILTER (y = c AND g = c) AS h FROM g, (SELECT unnest([-1, 0, 1]) AS c) GROUP BY 1, 2), ba AS (SELECT k, avg(CASE WHEN t > 0 THEN h / t END) AS ba, avg(CASE WHEN t + p > 0 THEN 2 * h / (t + p) END) AS f1 FROM l GROUP BY k), e AS (SELECT k, sum(m * gap) / sum(m) AS ece FROM (SELECT k, ceil(top * 10) AS bin, count(*) AS m, abs(avg((g = y)::INT::DOUBLE) - avg(top)) AS gap FROM g GROUP BY 1, 2) GROUP BY k) SELECT n.k, n, round(accuracy, 6) AS accuracy, round(ba.ba, 6) AS balanced_accuracy, round(f1, 6) AS macro_f1, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(ece, 6) AS ece, round(nn, 6) AS no_news_rate FROM n JOIN ba ON ba.k = n.k JOIN e ON e.k = n.k")
def ag10_classification_report(spark, d):
    p = predictions(spark, d)
    gap = (F.col("prediction") - F.col("origin")) / 200
    p = p.withColumns({"y": F.when(F.col("actual") > F.col("origin") + 300, 1).when(F.col("actual") < F.col("origin") - 300, -1).otherwise(0), "up": 0.1 + 0.7 / (1 + F.exp(-gap)), "down": 0.1 + 0.7 / (1 + F.exp(gap))})
    p = p.withColumn("flat", 1 - F.col("up") - F.col("down"))
    return rounded(score.classification_report(p, K, "y", {1: "up", 0: "flat", -1: "down"}, F.abs(F.col("up") - F.col("down")) < 0.01))


SAVING = "CASE WHEN prediction - origin >= 5 THEN 100 * (actual - origin - 1.5) ELSE 0 END"
GATE = PRED + f", b AS (SELECT *, origin - 1000 AS lower, origin + 1000 AS upper, origin - 900 AS il, origin + 1200 AS iu, abs(prediction - actual) AS e, abs(origin - actual) AS i, {SAVING} AS sv FROM r)"


def boot(value: str, source: str, means: str) -> str:
    """The SQL of ``block_bootstrap`` with blocks of 8, 100 resamples and seed 1; ``means`` names the result (k, resample, mean)."""
    q = f"{means}_q"
    return f""", {q} AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY date) AS i, sum({value}) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM {source}),
{q}n AS (SELECT k, max(i) AS n, least(8, max(i)) AS b FROM {q} GROUP BY k), {q}d AS (SELECT k, n, b, resample, unnest(range(ceil(n / b)::BIGINT)) AS j FROM (SELECT *, unnest(range(1, 101)) AS resample FROM {q}n)),
{q}s AS (SELECT *, ('0x' || substr(md5('1|' || resample || '|' || j), 1, 8))::BIGINT % (n - b + 1) AS a, least(b, n - j * b) AS z FROM {q}d),
{means} AS (SELECT st.k, resample, sum(e.s - coalesce(s0.s, 0)) / max(n) AS mean FROM {q}s st JOIN {q} e ON e.k = st.k AND e.i = st.a + st.z LEFT JOIN {q} s0 ON s0.k = st.k AND s0.i = st.a GROUP BY 1, 2)"""


@query(f"WITH {GATE}{boot('e - i', 'b', 'm')}{boot('sv', 'b', 'ms')}, h AS (SELECT k, quantile_cont(mean, 0.95) AS hi FROM m GROUP BY k), hs AS (SELECT k, 52 * quantile_cont(mean, 0.05) AS yr FROM ms GROUP BY k), a AS (SELECT k, avg(e) AS e, avg(i) AS i, avg(e) FILTER (i > 30) AS ee, avg(i) FILTER (i > 30) AS ie, avg(e) FILTER (i <= 30) AS eq, avg(i) FILTER (i <= 30) AS iq, max(e * e) / sum(e * e) AS s, avg((actual BETWEEN lower AND upper)::INT::DOUBLE) AS c, avg(upper - lower + 10 * greatest(lower - actual, actual - upper, 0)) AS w, avg(iu - il + 10 * greatest(il - actual, actual - iu, 0)) AS wi FROM b GROUP BY k), g AS (SELECT a.k, coalesce(e < i, false) AS g1, coalesce(hi < 0, false) AS g2, coalesce(ee <= 1.02 * ie, false) AS g3, coalesce(eq <= 1.02 * iq, false) AS g4, s <= 0.5 AS g5, abs(c - 0.8) <= 0.1 AS g6, yr > 0 AS g7, w <= wi AS g8 FROM a JOIN h ON h.k = a.k JOIN hs ON hs.k = a.k) SELECT k, unnest(['beats_incumbent', 'difference_below_zero', 'events', 'quiet', 'not_concentrated', 'calibrated', 'annual_savings', 'interval_score', 'all']) AS gate, unnest([g1, g2, g3, g4, g5, g6, g7, g8, g1 AND g2 AND g3 AND g4 AND g5 AND g6 AND g7 AND g8]) AS passed FROM g")
def ag16_evaluate_gates(spark, d):
    p = predictions(spark, d).withColumns({"incumbent": F.col("origin"), "lower": F.col("origin") - 1000, "upper": F.col("origin") + 1000})
    p = p.withColumn("diff", F.abs(F.col("prediction") - F.col("actual")) - F.abs(F.col("incumbent") - F.col("actual")))
    p = score.weekly_savings(p.withColumns({"incumbent_lower": F.col("origin") - 900, "incumbent_upper": F.col("origin") + 1200}), 1, 1000.0, 0.1, 5.0, 1.5)
    return score.evaluate_gates(p, K, score.block_bootstrap(p, K, "diff", "date", 8, 100), score.block_bootstrap(p, K, "saving", "date", 8, 100), 30.0)


@query(f"WITH {GATE}{boot('e - i', 'b', 'm')}, a AS (SELECT k, count(*) AS n, avg(e - i) AS d FROM b GROUP BY k) SELECT a.k, n, round(d, 6) AS mean_difference, round(quantile_cont(mean, 0.05), 6) AS low, round(quantile_cont(mean, 0.95), 6) AS high, round(avg((mean >= 0)::INT::DOUBLE), 6) AS p_not_better, round(avg((abs(mean - d) >= abs(d))::INT::DOUBLE), 6) AS p_two_sided FROM a JOIN m ON m.k = a.k GROUP BY a.k, n, d")
def ag14_paired_bootstrap(spark, d):
    p = predictions(spark, d).withColumns({"a": F.abs(F.col("prediction") - F.col("actual")), "b": F.abs(F.col("origin") - F.col("actual"))})
    return rounded(score.paired_bootstrap(p, K, "a", "b", "date", 8, 100))


@query(f"WITH {GATE}{boot('sv', 'b', 'm')}, c AS (SELECT k, 52 * quantile_cont(mean, 0.05) AS lo, 52 * quantile_cont(mean, 0.95) AS hi FROM m GROUP BY k) SELECT b.k, count(*) AS weeks, count(*) FILTER (prediction - origin >= 5) AS triggers, round(avg((actual > origin)::INT::DOUBLE) FILTER (prediction - origin >= 5), 6) AS precision, round(sum(sv), 2) AS total, round(sum(greatest(sv, 0)), 2) AS gross_profit, round(sum(greatest(-sv, 0)), 2) AS gross_loss, round(sum(sv) / sum(1000 * origin), 8) AS return_on_spend, round(avg(sv) * 52, 2) AS annualised, round(CASE WHEN sum(sv) > 0 THEN max(sv) / sum(sv) END, 6) AS largest_share, count(*) FILTER (datediff('day', date, target_date) <> 7) AS off_calendar, round(max(lo), 2) AS annual_low, round(max(hi), 2) AS annual_high FROM b JOIN c ON c.k = b.k GROUP BY b.k")
def dc1_prebuy_summary(spark, d):
    p = score.weekly_savings(predictions(spark, d), 1, 1000.0, 0.1, 5.0, 1.5)
    x = score.replay_summary(p, K, 1, 1000.0, 0.1, 5.0, 1.5, score.block_bootstrap(p, K, "saving", "date", 8, 100))
    digits = {"precision": 6, "largest_share": 6, "return_on_spend": 8}
    return x.select(*[F.round(f.name, digits.get(f.name, 2)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in x.schema])


@query(f"WITH {PRED}, l AS (SELECT k, date, (prediction - actual) ** 2 AS a, (origin - actual) ** 2 AS b, (lag(origin) OVER (PARTITION BY k ORDER BY date) - actual) ** 2 AS c FROM r), w AS (SELECT k, CASE WHEN count(*) OVER v >= 13 THEN sqrt(avg(a) OVER v / avg(b) OVER v) END AS r FROM l WINDOW v AS (PARTITION BY k ORDER BY date ROWS 12 PRECEDING)), g AS (SELECT k, count(*) AS n, sqrt(avg(a) / avg(b)) AS ratio, sqrt(avg(a) / avg(c)) AS ratio_naive, avg(a - b) / sqrt(var_samp(a - b) / count(*)) AS dm FROM l GROUP BY k), x AS (SELECT g.*, m.r AS worst_ratio FROM g JOIN (SELECT k, max(r) AS r FROM w GROUP BY k) m ON m.k = g.k) SELECT k, n, round(ratio, 6) AS ratio, round(ratio_naive, 6) AS ratio_naive, round(worst_ratio, 6) AS worst_ratio, round(dm, 6) AS dm, CASE WHEN n < 26 THEN 'collect' WHEN ratio <= 0.98 AND ratio_naive <= 0.98 AND worst_ratio <= 1.05 AND dm < -1.6448536269514722 THEN 'promote' ELSE 'hold' END AS status FROM x")
def ag17_promotion_report(spark, d):
    p = predictions(spark, d).withColumns({"incumbent": F.col("origin"), "naive": F.lag("origin", 1).over(features.by_date(K))})
    return rounded(score.promotion_report(p, K, "date"))


@query(f"WITH {PRED}, x AS (SELECT k, prediction - origin AS x, actual - origin AS y FROM r), q AS (SELECT k, quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.8) AS b FROM x GROUP BY k) SELECT x.k, round(corr(x, y), 6) AS corr, round(avg(y) FILTER (x <= a), 5) AS low_mean, round(avg(y) FILTER (x >= b), 5) AS high_mean, round(avg((abs(y) > 500)::INT::DOUBLE) FILTER (x <= a), 6) AS low_events, round(avg((abs(y) > 500)::INT::DOUBLE) FILTER (x >= b), 6) AS high_events FROM x JOIN q ON q.k = x.k GROUP BY x.k")
def ag19_quintile_study(spark, d):
    p = predictions(spark, d).withColumns({"x": F.col("prediction") - F.col("origin"), "y": F.col("actual") - F.col("origin")})
    q = score.quintile_study(p, K, "x", "y", 500.0)
    return q.select("k", *[F.round(c, 5 if c.endswith("mean") else 6).alias(c) for c in q.columns[1:]])


@query(f"WITH {PRED}, x AS (SELECT k, prediction - actual AS a, origin - actual AS b FROM r), y AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY a) + (count(*) OVER (PARTITION BY k, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY k ORDER BY b) + (count(*) OVER (PARTITION BY k, b) - 1) / 2 AS rb, row_number() OVER (PARTITION BY k ORDER BY abs(a) DESC, a, b) AS i FROM x), q AS (SELECT k, quantile_cont(abs(a), 0.9) AS ca, quantile_cont(abs(b), 0.9) AS cb FROM x GROUP BY k) SELECT y.k, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(corr(a, b) FILTER (i > 1), 6) AS pearson_without_1, round(corr(a, b) FILTER (i > 3), 6) AS pearson_without_3, round(corr(a, b) FILTER (i > 5), 6) AS pearson_without_5, round(count(*) FILTER (abs(a) >= ca AND abs(b) >= cb) / count(*) FILTER (abs(a) >= ca), 6) AS tail_dependence FROM y JOIN q ON q.k = y.k GROUP BY y.k")
def ag20_residual_redundancy(spark, d):
    p = predictions(spark, d).withColumns({"a": F.col("prediction") - F.col("actual"), "b": F.col("origin") - F.col("actual")})
    return rounded(score.residual_redundancy(p, K, "a", "b"))


LONG = PRED + ", lg AS (SELECT k, date, actual, 'mean4' AS model, prediction FROM r UNION ALL SELECT k, date, actual, 'naive', origin FROM r)"


def long(spark, d):
    """One row per model: the mean of four weeks and the last price."""
    p = predictions(spark, d).withColumnsRenamed({"prediction": "mean4", "origin": "naive"})
    return p.unpivot(["k", "date", "actual"], ["mean4", "naive"], "model", "prediction")


@query(f"WITH {LONG}, m AS (SELECT k, model, round(avg(abs(prediction - actual)), 6) AS mae FROM lg GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY mae, model) AS i FROM m) SELECT k, mae, model FROM i WHERE i = 1")
def ag21_best_per_group(spark, d):
    m = long(spark, d).groupBy("k", "model").agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("actual"))), 6).alias("mae"))
    return score.best_per_group(m, K, "mae", "model")


@query(f"WITH {PRED}, i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date DESC) AS i FROM r), l AS (SELECT k, prediction AS h, origin AS o FROM i WHERE i = 1), m AS (SELECT i.k, h + (actual - prediction) - o AS m FROM i JOIN l ON l.k = i.k WHERE i <= 104) SELECT k, round(avg((m > 100)::INT::DOUBLE), 6) AS up, round(avg((abs(m) <= 100)::INT::DOUBLE), 6) AS flat, round(avg((m < -100)::INT::DOUBLE), 6) AS down FROM m GROUP BY k HAVING count(*) >= 20")
def ag22_direction_probs(spark, d):
    p = predictions(spark, d).withColumn("resid", F.col("actual") - F.col("prediction"))
    return rounded(score.direction_probs(p, K, "resid", "prediction", "origin", "date", 100.0))


@query(f"WITH {PRED}, g AS (SELECT unnest(range(11)) AS i), m AS (SELECT k, i, round(avg(abs(i / 10 * prediction + (10 - i) / 10 * origin - actual)), 9) AS mae FROM r, g GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY mae, i) AS o FROM m) SELECT k, round(mae, 6) AS mae, i / 10 AS w_prediction, (10 - i) / 10 AS w_origin FROM o WHERE o = 1")
def ag23_convex_weights(spark, d):
    return rounded(score.convex_weights(predictions(spark, d), K, ["prediction", "origin"], "actual"))


@query(f"WITH {PRED}, x AS (SELECT * FROM r, (SELECT unnest([1, 2, 3]) AS h)), a AS (SELECT *, row_number() OVER (PARTITION BY k, h ORDER BY date) AS i, row_number() OVER (PARTITION BY k, h ORDER BY md5('1|' || h || '|' || date)) AS j FROM x), m AS (SELECT a.k, a.actual AS y, a.prediction AS p, a.origin AS o, b.prediction AS mp, b.origin AS mo FROM a JOIN a b ON b.k = a.k AND b.h = a.h AND b.j = a.i), g AS (SELECT k, avg((0.7 * p + 0.3 * o - y) ** 2) AS b, avg((0.7 * mp + 0.3 * o - y) ** 2) AS fp, avg((0.7 * p + 0.3 * mo - y) ** 2) AS fo FROM m GROUP BY k) SELECT k, unnest(['prediction', 'origin']) AS feature, round(unnest([fp - b, fo - b]), 2) AS importance FROM g")
def ag24_permutation_importance(spark, d):
    return rounded(score.permutation_importance(predictions(spark, d), K, {"prediction": 0.7, "origin": 0.3}, "actual", "date"), 2)


@query(f"WITH {PRED}, x AS (SELECT * FROM r, (SELECT unnest([1, 2, 3]) AS h)), a AS (SELECT *, row_number() OVER (PARTITION BY k, h ORDER BY date) AS i, row_number() OVER (PARTITION BY k, h ORDER BY md5('1|' || h || '|' || date)) AS j FROM x), m AS (SELECT a.k, a.actual AS y, a.prediction AS p, a.origin AS o, b.prediction AS mp, b.origin AS mo FROM a JOIN a b ON b.k = a.k AND b.h = a.h AND b.j = a.i), g AS (SELECT k, avg((greatest(p, o) - y) ** 2) AS b, avg((greatest(mp, o) - y) ** 2) AS fp, avg((greatest(p, mo) - y) ** 2) AS fo FROM m GROUP BY k) SELECT k, unnest(['prediction', 'origin']) AS feature, round(unnest([fp - b, fo - b]), 2) AS importance FROM g")
def ag24_callable_importance(spark, d):
    """A scorer that no weights can express: the larger of the two columns."""
    larger = lambda rows: rows.max(axis=1)
    return rounded(score.permutation_importance(predictions(spark, d), K, ["prediction", "origin"], "actual", "date", scorer=larger), 2)


@query(f"WITH {LONG}, w AS (SELECT model, 1 / avg(abs(prediction - actual)) AS w FROM lg GROUP BY 1) SELECT k, date, round(sum(w * prediction) / sum(w), 6) AS prediction FROM lg JOIN w ON w.model = lg.model GROUP BY 1, 2")
def ag26_stacked_ensemble(spark, d):
    x = long(spark, d)
    w = x.groupBy("model").agg((1 / F.avg(F.abs(F.col("prediction") - F.col("actual")))).alias("weight"))
    return rounded(score.stacked_ensemble(x, w, ["k", "date"]))


@query(f"WITH {PANEL}, e AS (SELECT k, year(date) AS y, sum(price - 1900) AS s, sum(price) AS c, count(*) AS w FROM p GROUP BY 1, 2) SELECT k, count(*) AS triggers, round(avg((s > 0)::INT::DOUBLE), 6) AS win_rate, round(sum(s), 4) AS total, round(avg(s), 4) AS expectancy, CASE WHEN count(*) FILTER (s < 0) = 0 THEN 'inf'::DOUBLE ELSE round(coalesce(sum(s) FILTER (s > 0), 0) / -sum(s) FILTER (s < 0), 6) END AS profit_factor, round(coalesce(sum(s) FILTER (s > 0), 0), 4) AS gross_profit, round(coalesce(-sum(s) FILTER (s < 0), 0), 4) AS gross_loss, round(sum(s) / sum(c), 8) AS return_on_spend, round(52 * sum(s) / sum(w), 4) AS annualised, round(CASE WHEN sum(s) > 0 THEN max(s) / sum(s) END, 6) AS largest_share FROM e GROUP BY k")
def ag9_profitability(spark, d):
    e = panel(spark, d).groupBy("k", F.year("date").alias("y")).agg(F.sum(F.col("price") - 1900).alias("saving"), F.sum("price").alias("spend"), F.count(F.lit(1)).alias("weeks"))
    digits = {"win_rate": 6, "profit_factor": 6, "return_on_spend": 8, "largest_share": 6}
    x = score.profitability(e, K, spend="spend", weeks="weeks")
    return x.select("k", "triggers", *[F.round(c, digits.get(c, 4)).alias(c) for c in x.columns[2:]])
