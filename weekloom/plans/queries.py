"""Registered queries over the given tables, each with the SQL that says the same.

Panel: per nation and week of shipping, the mean price a unit; weeks start on Monday. Money is summed in whole cents, so the panel
is the same to the last bit in any order of rows; results whose sums depend on the order are rounded to six digits.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.functions import prep
from weekloom.operators import align, features, score

K = ["k"]
ROUND = 6


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(column: str):
    """The exact sum in cents."""
    return F.sum(F.round(F.col(column) * 100).cast("long")).cast("double")


def panel(spark, d: str) -> DataFrame:
    """(k, date, price, stations). Suppliers are a dimension that Spark broadcasts while it is small."""
    x = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("s_nationkey").alias("k"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg((cents("l_extendedprice") / (100 * F.sum("l_quantity"))).alias("price"), F.count_distinct("l_suppkey").alias("stations"))


def cost(spark, d: str) -> DataFrame:
    """(date, cost): mean order value of the days that have orders."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return o.groupBy("date").agg((cents("o_totalprice") / (100 * F.count("o_totalprice"))).alias("cost"))


def with_cost(spark, d: str) -> DataFrame:
    """The panel with the last known cost. Dates are resolved once on the calendar, then joined."""
    p = panel(spark, d)
    weeks = align.asof_backward(p.select("date").distinct(), cost(spark, d), [], ["cost"])
    return p.join(weeks, "date")


def predictions(spark, d: str, horizon: int = 1) -> DataFrame:
    """Mean-of-four forecasts of the price ``horizon`` weeks ahead on the calendar."""
    p = align.calendar_target(panel(spark, d), K, "price", horizon)
    p = p.withColumn("prediction", features.over(F.avg, "price", K, -3, 0, 1))
    return p.select("k", F.col("date"), "target_date", F.col("target").alias("actual"), F.col("price").alias("origin"), "prediction").filter("actual is not null")


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


PANEL = """p AS (SELECT s_nationkey AS k, date_trunc('week', l_shipdate)::DATE AS date, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / (100 * sum(l_quantity)) AS price, count(DISTINCT l_suppkey) AS stations FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
COST = PANEL + """, c AS (SELECT o_orderdate::DATE AS date, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / (100 * count(o_totalprice)) AS cost FROM orders GROUP BY 1), x AS (SELECT p.*, c.cost FROM p ASOF LEFT JOIN c ON p.date >= c.date)"""
PRED = PANEL + """, f AS (SELECT k, date, price, avg(price) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS prediction FROM p), r AS (SELECT f.k, f.date, t.date AS target_date, t.price AS actual, f.price AS origin, f.prediction FROM f JOIN p t ON t.k = f.k AND t.date = f.date + INTERVAL 7 DAY)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {PRED} SELECT k, count(*) AS n, count(*) FILTER (abs(actual - origin) > 30) AS n_event, round(avg(abs(prediction - actual)), 6) AS mae, round(sqrt(avg((prediction - actual) ** 2)), 6) AS rmse, round(avg(abs(prediction - actual)) FILTER (abs(actual - origin) > 30), 6) AS mae_event, round(avg(abs(prediction - actual)) FILTER (abs(actual - origin) <= 30), 6) AS mae_quiet, round(avg((sign(prediction - origin) = sign(actual - origin))::INT::DOUBLE) FILTER (actual <> origin), 6) AS direction, round(max((prediction - actual) ** 2) / sum((prediction - actual) ** 2), 6) AS largest_share FROM r GROUP BY k")
def ag5_accuracy_report(spark, d):
    return rounded(score.accuracy_report(predictions(spark, d), K, 30.0))


@query(f"WITH {PRED} SELECT k, count(*) AS n, round(avg((prediction - actual) ** 2), 2) AS mse, round(sqrt(avg((prediction - actual) ** 2)), 6) AS rmse, round(avg(abs(prediction - actual)), 6) AS mae, round(avg(CASE WHEN abs(actual) + abs(prediction) = 0 THEN 0 ELSE 2 * abs(prediction - actual) / (abs(actual) + abs(prediction)) END), 6) AS smape, round(sqrt(avg((prediction - actual) ** 2)) / stddev_pop(actual), 6) AS ndei FROM r GROUP BY k")
def ag3_regression_metrics(spark, d):
    return rounded(score.regression_metrics(predictions(spark, d), K).withColumn("mse", F.round("mse", 2)))


@query(f"WITH {PRED} SELECT k, round(avg(prediction - actual), 6) AS bias, round(max(abs(prediction - actual)), 6) AS max_abs, round(median(abs(prediction - actual)), 6) AS median_abs, round(avg(abs(prediction - actual)) / avg(abs(origin - actual)), 6) AS ratio_naive FROM r GROUP BY k")
def ag6_metric_row(spark, d):
    return rounded(score.metric_row(predictions(spark, d), K))


BAND = PRED + ", b AS (SELECT *, origin - 40 AS lower, origin + 50 AS upper FROM r)"


def banded(spark, d):
    return predictions(spark, d).withColumns({"lower": F.col("origin") - 40, "upper": F.col("origin") + 50})


@query(f"WITH {BAND}, bb AS (SELECT * REPLACE (upper + abs(prediction - origin) / 10 AS upper) FROM b), z AS (SELECT *, (actual BETWEEN lower AND upper)::INT::DOUBLE AS i, upper - lower AS w, abs(actual - origin) > 30 AS e FROM bb) SELECT k, round(avg(i), 6) AS coverage, round(avg(i) - 0.8, 6) AS calibration_error, round(avg(w), 6) AS mean_width, round(median(w), 6) AS median_width, round(avg(w + 2.0 / 0.2 * greatest(lower - actual, actual - upper, 0)), 6) AS winkler, round(avg(i) FILTER (e), 6) AS coverage_event, round(avg(i) FILTER (NOT e), 6) AS coverage_quiet, round(avg(w) FILTER (e) / avg(w) FILTER (NOT e), 6) AS width_ratio FROM z GROUP BY k")
def ag7_interval_report(spark, d):
    wide = banded(spark, d).withColumn("upper", F.col("upper") + F.abs(F.col("prediction") - F.col("origin")) / 10)
    return rounded(score.interval_report(wide, K, 0.2, 30.0))


@query(f"WITH {BAND}, z AS (SELECT k, actual - lower AS d FROM b) SELECT k, round(avg(greatest(0.1 * d, -0.9 * d)), 6) AS pinball FROM z GROUP BY k")
def ag4_pinball(spark, d):
    return rounded(banded(spark, d).groupBy("k").agg(score.pinball("lower", 0.1).alias("pinball")))


@query(f"WITH {BAND}, e AS (SELECT *, abs(prediction - actual) AS e, (sign(prediction - origin) = sign(actual - origin))::INT::DOUBLE AS h FROM b) SELECT k, round(avg(h) FILTER (actual <> origin), 6) AS hit_rate, round(avg(h) FILTER (abs(actual - origin) > 30), 6) AS hit_rate_event, round(avg(h) FILTER (abs(actual - origin) <= 30 AND actual <> origin), 6) AS hit_rate_quiet, count(*) FILTER (abs(actual - origin) > 30) AS n_event, round(avg((actual BETWEEN lower AND upper)::INT::DOUBLE), 6) AS coverage, round(avg((e <= 0.01)::INT::DOUBLE), 6) AS within_1, round(avg((e <= 0.02)::INT::DOUBLE), 6) AS within_2, round(avg((e <= 0.05)::INT::DOUBLE), 6) AS within_5, round(avg((e <= 0.1)::INT::DOUBLE), 6) AS within_10, round(median(e), 6) AS median_abs, round(avg(e), 6) AS mean_abs FROM e GROUP BY k")
def ag8_performance_report(spark, d):
    return rounded(score.performance_report(banded(spark, d), K, 30.0))


@query("WITH d AS (SELECT * FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*) AS n, avg((quality = toxic)::INT::DOUBLE) AS o FROM d), a AS (SELECT quality AS l, count(*) AS na FROM d GROUP BY 1), b AS (SELECT toxic AS l, count(*) AS nb FROM d GROUP BY 1), s AS (SELECT sum(na * nb)::DOUBLE AS s FROM a JOIN b USING (l)) SELECT n, round(o, 6) AS observed, round((o - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, s")
def ag11_cohen_kappa(spark, d):
    return rounded(score.cohen_kappa(table(spark, d, "labels"), "quality", "toxic"))


@query(f"WITH {PRED}, l AS (SELECT k, date, (prediction - actual) ** 2 - (origin - actual) ** 2 AS d, lag((prediction - actual) ** 2 - (origin - actual) ** 2) OVER (PARTITION BY k ORDER BY date) AS d1 FROM r), g AS (SELECT k, count(d) AS n, avg(d) AS m, var_samp(d) + 2 * 0.5 * covar_samp(d, d1) AS v FROM l GROUP BY k) SELECT k, n, round(m, 4) AS mean_diff, round(m / sqrt(CASE WHEN v > 0 THEN v END / n), 4) AS dm, round(m / sqrt(CASE WHEN v > 0 THEN v END / n) * sqrt((n + 1 - 4 + 2.0 / n) / n), 4) AS dm_hln FROM g")
def ag13_dm_statistic(spark, d):
    sq = lambda c: (F.col(c) - F.col("actual")) * (F.col(c) - F.col("actual"))
    p = predictions(spark, d).withColumns({"a": sq("prediction"), "b": sq("origin")})
    return rounded(score.dm_statistic(p, K, "a", "b", "date", 2).drop("lrv"), 4)

@query(f"""WITH {PRED}, l AS (SELECT k, date, (prediction - actual) ** 2 - (origin - actual) ** 2 AS d, lag((prediction - actual) ** 2 - (origin - actual) ** 2) OVER (PARTITION BY k ORDER BY date) AS d1 FROM r),
g AS (SELECT k, count(d) AS n, avg(d) AS m, var_samp(d) + 2 * 0.5 * covar_samp(d, d1) AS v FROM l GROUP BY k), s AS (SELECT k, n, n - 1 AS f, v, m / sqrt(CASE WHEN v > 0 THEN v END / n) AS z FROM g),
t AS (SELECT *, abs(z * sqrt((n + 1 - 4 + 2.0 / n) / n)) AS t, abs(z) / sqrt(2) AS x FROM s), c AS (SELECT *, f / (f + t * t) AS c2, t / sqrt(f + t * t) AS sn FROM t)
SELECT k, n, round(CASE WHEN v <= 0 THEN 1 WHEN x = 0 THEN 1 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln(x) - x * x - lgamma(i + 1.5))))) END, 6) + 0.0 AS p_normal,
round(CASE WHEN v <= 0 THEN 1 WHEN f >= 1 THEN greatest(0, 1 - CASE WHEN f % 2 = 0 THEN sn * list_sum(list_transform(range(0, f // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5) + j * ln(c2))))
ELSE 2 / pi() * (atan(t / sqrt(f)) + coalesce(sn * sqrt(c2) * list_sum(list_transform(range(0, (f - 1) // 2), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5) + lgamma(1.5) + j * ln(c2)))), 0)) END) END, 6) + 0.0 AS p_t FROM c""")
def ag13_dm_test(spark, d):
    sq = lambda c: (F.col(c) - F.col("actual")) * (F.col(c) - F.col("actual"))
    p = predictions(spark, d).withColumns({"a": sq("prediction"), "b": sq("origin")})
    return rounded(score.dm_test(p, K, "a", "b", "date", 2).select("k", "n", "p_normal", "p_t"))


@query(f"""WITH {PRED}, q AS (SELECT k, row_number() OVER w AS i, sum(abs(prediction - actual)) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM r WINDOW w AS (PARTITION BY k ORDER BY date)),
n AS (SELECT k, max(i) AS n, least(8, max(i)) AS b FROM q GROUP BY k), dr AS (SELECT k, n, b, resample, unnest(range(ceil(n / b)::BIGINT)) AS j FROM (SELECT *, unnest(range(1, 101)) AS resample FROM n)),
st AS (SELECT *, ('0x' || substr(md5('1|' || resample || '|' || j), 1, 8))::BIGINT % (n - b + 1) AS a, least(b, n - j * b) AS z FROM dr),
m AS (SELECT st.k, resample, sum(e.s - coalesce(s0.s, 0)) / max(n) AS mean FROM st JOIN q e ON e.k = st.k AND e.i = st.a + st.z LEFT JOIN q s0 ON s0.k = st.k AND s0.i = st.a GROUP BY 1, 2)
SELECT k, round(quantile_cont(mean, 0.05), 6) AS low, round(quantile_cont(mean, 0.95), 6) AS high FROM m GROUP BY k""")
def ag14_block_bootstrap(spark, d):
    p = predictions(spark, d).withColumn("e", F.abs(F.col("prediction") - F.col("actual")))
    return rounded(score.bootstrap_ci(score.block_bootstrap(p, K, "e", "date", 8, 100), K))


@query("SELECT user_id, date_trunc('day', ts)::DATE AS period, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_latency, greatest(20 - count(*), 0) AS left, round(count(*) / 20, 6) AS used, count(*) > 20 AS exceeded FROM events GROUP BY 1, 2")
def ag25_usage_summary(spark, d):
    e = table(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "error", 500).otherwise(200))
    return rounded(score.usage_summary(e, "user_id", "status", "value", F.to_date("ts"), 20))


@query("SELECT user_id, date_trunc('day', ts)::DATE AS period, event_type, count(*) AS calls FROM events GROUP BY 1, 2, 3")
def ag25_usage_by_path(spark, d):
    return score.usage_by_path(table(spark, d, "events"), "user_id", "event_type", F.to_date("ts"))


@query("WITH w AS (SELECT user_id, ts::DATE AS period, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM events) SELECT user_id, period, max(n) AS peak FROM w GROUP BY 1, 2")
def ag25_peak_calls(spark, d):
    return score.peak_calls(table(spark, d, "events"), "user_id", F.col("ts"), F.to_date("ts"))


@query(f"WITH {PANEL}, f AS (SELECT k AS candidate, year(date) AS y, avg(price) AS s FROM p GROUP BY 1, 2), g AS (SELECT candidate, avg(s) AS mean, max(s) AS worst, stddev_pop(s) AS dev FROM f GROUP BY 1) SELECT candidate, round(mean, 6) AS mean, round(worst, 6) AS worst, round(dev, 6) AS dev, round(mean + 0.2 * worst + 0.1 * dev, 6) AS selection, worst < 1950 AS eligible, row_number() OVER (ORDER BY mean + 0.2 * worst + 0.1 * dev, candidate) AS place FROM g")
def ag15_rank_candidates(spark, d):
    s = panel(spark, d).groupBy(F.col("k").alias("candidate"), F.year("date").alias("y")).agg(F.avg("price").alias("score"))
    return rounded(score.rank_candidates(s, limit=1950.0))


@query(f"WITH {PRED}, e AS (SELECT k, 100.0 * (actual - origin - 1.5) AS s FROM r WHERE prediction - origin >= 5) SELECT k, count(*) AS triggers, round(sum(s), 1) AS total, round(avg((s > 0)::INT::DOUBLE), 6) AS win_rate, round(sum(s) FILTER (s > 0) / -sum(s) FILTER (s < 0), 6) AS profit_factor, round(avg(s), 2) AS expectancy, round(CASE WHEN sum(s) > 0 THEN max(s) / sum(s) END, 6) AS largest_share FROM e GROUP BY k")
def dc1_prebuy_profitability(spark, d):
    e = score.prebuy_replay(predictions(spark, d), K, 1, 1000.0, 0.1, 5.0, 1.5)
    p = score.profitability(e, K)
    return p.select("k", "triggers", F.round("total", 1).alias("total"), F.round("win_rate", 6).alias("win_rate"), F.round("profit_factor", 6).alias("profit_factor"), F.round("expectancy", 2).alias("expectancy"), F.round("largest_share", 6).alias("largest_share"))


@query(f"WITH {PANEL}, e AS (SELECT k, min(date) AS a, max(date) AS b FROM p GROUP BY k), g AS (SELECT k, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY))::DATE AS date FROM e) SELECT g.k, g.date, p.price, p.stations::DOUBLE AS stations FROM g LEFT JOIN p ON p.k = g.k AND p.date = g.date")
def jn1_weekly_grid(spark, d):
    return align.weekly_grid(panel(spark, d), K).select("k", "date", "price", F.col("stations").cast("double").alias("stations"))


@query(f"WITH {COST} SELECT k, date, price, cost FROM x")
def jn2_asof_backward(spark, d):
    return with_cost(spark, d).select("k", "date", "price", "cost")


@query(f"WITH {COST}, w AS (SELECT DISTINCT date FROM p), n AS (SELECT w.date, c.cost, row_number() OVER (PARTITION BY w.date ORDER BY abs(datediff('day', c.date, w.date)), c.date) AS i FROM w LEFT JOIN c ON abs(datediff('day', c.date, w.date)) <= 1) SELECT date, cost FROM n WHERE i = 1")
def jn3_asof_nearest(spark, d):
    return align.asof_nearest(panel(spark, d).select("date").distinct(), cost(spark, d), [], "cost", 1).select("date", "cost")


@query(f"WITH {PANEL} SELECT a.k, a.date, a.price, b.price AS target, (a.date + INTERVAL 28 DAY)::DATE AS target_date FROM p a LEFT JOIN p b ON b.k = a.k AND b.date = a.date + INTERVAL 28 DAY")
def jn5_calendar_target(spark, d):
    return align.calendar_target(panel(spark, d), K, "price", 4).select("k", "date", "price", "target", "target_date")


@query(f"WITH {PANEL}, l AS (SELECT k, date, price, lag(price, 1) OVER w AS lag_1, lag(price, 4) OVER w AS lag_4, lead(price, 2) OVER w AS target, lead(date, 2) OVER w AS target_date FROM p WINDOW w AS (PARTITION BY k ORDER BY date)) SELECT * FROM l WHERE lag_4 IS NOT NULL AND target IS NOT NULL")
def jn6_lagged_dataset(spark, d):
    return align.lagged_dataset(panel(spark, d).drop("stations"), K, "price", [1, 4], 2)


@query(f"WITH {PANEL}, b AS (SELECT k, date, count(*) OVER (PARTITION BY k) - row_number() OVER (PARTITION BY k ORDER BY date) AS back FROM p) SELECT k, date, CASE WHEN back < 52 THEN 'holdout' WHEN 3 - floor((back - 52) / 26.0) >= 1 THEN 'validation_' || (3 - floor((back - 52) / 26.0))::BIGINT ELSE 'train' END AS fold FROM b")
def jn10_expanding_folds(spark, d):
    return align.expanding_folds(panel(spark, d), K, 52, 26, 3).select("k", "date", "fold")


@query(f"WITH {PRED} SELECT a.k, a.date, (SELECT count(*) FROM r b WHERE b.k = a.k AND b.target_date <= a.date) AS known FROM r a")
def jn13_known_target_end(spark, d):
    return align.known_target_end(predictions(spark, d), K).select("k", "date", "known")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS sha, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id * 7 % 2000) AS t FROM documents), o AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-07', TIMESTAMP '2024-03-24', INTERVAL 7 DAY)) AS origin),
h AS (SELECT origin::DATE AS origin, doc_id, row_number() OVER (PARTITION BY origin, sha ORDER BY t, doc_id) AS i FROM a JOIN o ON t <= origin AND t > origin - INTERVAL 14 DAY) SELECT origin, doc_id FROM h WHERE i = 1""")
def jn7_articles_in_lookback(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(doc_id * 7 % 2000 as int))").alias("available"))
    o = spark.sql("select explode(sequence(date'2024-01-07', date'2024-03-24', interval 7 days)) as origin")
    return align.articles_in_lookback(a, o, 14, record="doc_id").select("origin", "doc_id")


@query(f"WITH {PANEL}, c AS (SELECT k, date, ln(price) - ln(lag(price) OVER (PARTITION BY k ORDER BY date)) AS c, price FROM p) SELECT k, date, lag(price, 4) OVER w AS l4, CASE WHEN count(price) OVER f8 >= 8 THEN round(avg(price) OVER f8, 6) END AS ma8, CASE WHEN count(c) OVER f8 >= 4 THEN round(stddev_samp(c) OVER f8, 6) END AS vol8 FROM c WINDOW w AS (PARTITION BY k ORDER BY date), f8 AS (PARTITION BY k ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)")
def wf1_weekly_features(spark, d):
    f = features.weekly_features(panel(spark, d), K, ["price"])
    return f.select("k", "date", F.col("price_l4").alias("l4"), F.round("price_ma8", 6).alias("ma8"), F.round("price_vol8", 6).alias("vol8"))


@query(f"WITH {PANEL}, c AS (SELECT k, date, price, ln(price) - ln(lag(price) OVER (PARTITION BY k ORDER BY date)) AS c FROM p), s AS (SELECT *, CASE WHEN count(c) OVER w >= 4 THEN stddev_samp(c) OVER w END AS sd, CASE WHEN count(price) OVER w >= 4 THEN (price - avg(price) OVER w) / stddev_samp(price) OVER w END AS z FROM c WINDOW w AS (PARTITION BY k ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), j AS (SELECT *, coalesce(abs(c) > 2.5 * greatest(sd, 1e-4), false) AS jump FROM s) SELECT k, date, jump, round(z, 6) AS z, jump OR coalesce(abs(z) > 2, false) AS adjusted FROM j")
def wf2_price_jump(spark, d):
    return rounded(features.price_jump_proxy(panel(spark, d), K, "price").select("k", "date", "jump", "z", "adjusted"))


@query(f"WITH {PANEL}, e AS (SELECT k, min(date) AS a, max(date) AS b FROM p GROUP BY k), g AS (SELECT k, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY))::DATE AS date FROM e), x AS (SELECT g.k, g.date, p.price FROM g LEFT JOIN p ON p.k = g.k AND p.date = g.date), y AS (SELECT *, price - lag(price) OVER (PARTITION BY k ORDER BY date) AS dd FROM x) SELECT k, date, CASE WHEN n = 13 THEN round(change_4, 6) END AS change_4, CASE WHEN n = 13 THEN round(gap_ma8, 6) END AS gap_ma8, CASE WHEN n = 13 THEN round(vol_12, 6) END AS vol_12 FROM (SELECT k, date, count(price) OVER (PARTITION BY k ORDER BY date ROWS 12 PRECEDING) AS n, (price - lag(price, 4) OVER (PARTITION BY k ORDER BY date)) / 4 AS change_4, price - avg(price) OVER (PARTITION BY k ORDER BY date ROWS 7 PRECEDING) AS gap_ma8, stddev_pop(dd) OVER (PARTITION BY k ORDER BY date ROWS 11 PRECEDING) AS vol_12 FROM y)")
def wf3_feature_set(spark, d):
    g = align.weekly_grid(panel(spark, d).drop("stations"), K)
    return rounded(features.feature_set(g, K, "price").select("k", "date", "change_4", "gap_ma8", "vol_12"))


@query(f"WITH {COST}, e AS (SELECT k, min(date) AS a, max(date) AS b FROM p GROUP BY k), g AS (SELECT k, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 7 DAY))::DATE AS date FROM e), y AS (SELECT g.k, g.date, x.price, x.cost FROM g LEFT JOIN x ON x.k = g.k AND x.date = g.date) SELECT k, date, CASE WHEN n = 13 THEN price END AS level, CASE WHEN n = 13 THEN round(change_1, 6) END AS change_1, CASE WHEN n = 13 THEN cost_l1 END AS cost_l1 FROM (SELECT k, date, price, count(price) OVER (PARTITION BY k ORDER BY date ROWS 12 PRECEDING) AS n, price - lag(price) OVER (PARTITION BY k ORDER BY date) AS change_1, lag(cost) OVER (PARTITION BY k ORDER BY date) AS cost_l1 FROM y)")
def wf3_exogenous_set(spark, d):
    g = align.weekly_grid(with_cost(spark, d).drop("stations"), K)
    return features.feature_set(g, K, "price", "exogenous", exogenous=["cost"]).select("k", "date", "level", F.round("change_1", 6).alias("change_1"), "cost_l1")


@query(f"WITH {COST}, l AS (SELECT k, date, ln(price) AS y, ln(cost) AS x FROM x WHERE cost IS NOT NULL), s AS (SELECT *, count(*) OVER w AS n, regr_slope(y, x) OVER w AS b, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM l WINDOW w AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), r AS (SELECT k, date, CASE WHEN n >= 52 THEN y - my - b * (x - mx) END AS r FROM s), v AS (SELECT k, date, r, count(r) OVER w AS n, stddev_samp(r) OVER w AS sd FROM r WINDOW w AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT k, date, CASE WHEN n >= 2 THEN round(r / sd, 3) + 0.0 END AS coint FROM v")
def wf6_coint_residual(spark, d):
    x = with_cost(spark, d).filter("cost is not null")
    return features.expanding_coint_residual(x, K, "price", "cost", 52).select("k", "date", (F.round("coint", 3) + 0.0).alias("coint"))


@query(f"WITH {PRED}, e AS (SELECT k, date, (actual - prediction) AS e FROM r) SELECT k, date, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY date) >= 12 THEN round(sqrt(avg(e * e) OVER (PARTITION BY k ORDER BY date ROWS 11 PRECEDING)), 6) END AS rmse FROM e")
def wf9_rolling_rmse(spark, d):
    return rounded(features.rolling_rmse(predictions(spark, d), K, "actual", "prediction").select("k", "date", "rmse"))


@query(f"WITH {PRED}, e AS (SELECT k, date, prediction, actual - prediction AS e FROM r), q AS (SELECT k, date, prediction, count(e) OVER w AS n, quantile_cont(e, 0.1) OVER w AS lo, quantile_cont(e, 0.9) OVER w AS hi FROM e WINDOW w AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT k, date, CASE WHEN n >= 20 THEN round(prediction + lo, 5) END AS lower, CASE WHEN n >= 20 THEN round(prediction + hi, 5) END AS upper FROM q")
def wf10_expanding_conformal(spark, d):
    p = predictions(spark, d).withColumn("resid", F.col("actual") - F.col("prediction"))
    return rounded(features.expanding_conformal(p, K, "resid", "prediction").select("k", "date", "lower", "upper"), 5)


@query(f"WITH {PANEL}, n AS (SELECT k, date, coalesce((datediff('day', lag(date) OVER (PARTITION BY k ORDER BY date), date) <> 7)::INT, 1) AS n FROM p), b AS (SELECT k, date, sum(n) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM n), c AS (SELECT *, count(*) OVER (PARTITION BY k, block) AS c FROM b) SELECT k, date, block FROM c WHERE c >= 3")
def wf13_contiguous_blocks(spark, d):
    return features.contiguous_blocks(panel(spark, d), K).select("k", "date", "block")


@query(f"WITH {PANEL}, g AS (SELECT *, price - avg(price) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g, lead(price, 1) OVER w - price AS d1, lead(price, 4) OVER w - price AS d4 FROM p WINDOW w AS (PARTITION BY k ORDER BY date)) SELECT k, unnest([1, 4]) AS horizon, round(unnest([corr(g, d1) ** 2, corr(g, d4) ** 2]), 6) AS r2 FROM g GROUP BY k")
def wf17_horizon_predictability(spark, d):
    return rounded(features.horizon_predictability(panel(spark, d), K, "price", (1, 4)))


@query("SELECT DISTINCT source, trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') AS name, upper(source) AS label FROM documents")
def prj1_normalize(spark, d):
    return table(spark, d, "documents").select("source").distinct().select("source", prep.normalize_name(F.col("source")).alias("name"), prep.normalize_label(F.col("source")).alias("label"))


@query("SELECT p_partkey, round(p_retailprice, 2) AS price FROM part")
def prj3_parse_price(spark, d):
    text = F.concat(F.lit("R$ "), F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")))
    return table(spark, d, "part").select("p_partkey", prep.parse_price(text).alias("price"))


@query("SELECT p_partkey, round(median(v), 6) AS median FROM (SELECT p_partkey, unnest([p_size::DOUBLE, p_retailprice / 100, CASE WHEN p_size % 2 = 0 THEN p_partkey::DOUBLE END]) AS v FROM part) GROUP BY 1")
def prj9_row_median(spark, d):
    p = table(spark, d, "part").withColumns({"b": F.col("p_retailprice") / 100, "c": F.when(F.col("p_size") % 2 == 0, F.col("p_partkey"))})
    return p.select("p_partkey", F.round(prep.row_median(["p_size", "b", "c"]), 6).alias("median"))


@query("""WITH s AS (SELECT source, lang, count(*) AS m FROM documents GROUP BY 1, 2), q AS (SELECT *, 100.0 * m / sum(m) OVER () AS e FROM s), b AS (SELECT *, floor(e) AS base, row_number() OVER (ORDER BY e - floor(e) DESC, source, lang) AS r FROM q), t AS (SELECT *, base + (r <= 100 - sum(base) OVER ())::INT AS quota FROM b),
k AS (SELECT doc_id, d.source, d.lang, quota, row_number() OVER (PARTITION BY d.source, d.lang ORDER BY sha256('7:' || doc_id)) AS i FROM documents d JOIN t ON t.source = d.source AND t.lang = d.lang) SELECT doc_id, source, lang FROM k WHERE i <= quota""")
def tx4_stratified_sample(spark, d):
    return score.stratified_sample(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 100, 7).select("doc_id", "source", "lang")


@query("SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st5_stream_weekly(spark, d):
    from weekloom.streaming.weekly import stream_weekly

    return stream_weekly(spark, d)


@query(f"WITH {PANEL} SELECT k, date, price AS naive, round(avg(price) OVER (PARTITION BY k ORDER BY date ROWS 3 PRECEDING), 6) AS ma4 FROM p")
def ml1_naive_and_mean(spark, d):
    return panel(spark, d).select("k", "date", F.col("price").alias("naive"), F.round(features.over(F.avg, "price", K, -3, 0, 1), 6).alias("ma4"))


@query(f"WITH {PRED}, q AS (SELECT k, date, prediction, count(actual - prediction) OVER w AS n, quantile_cont(actual - prediction, 0.1) OVER w AS lo, quantile_cont(actual - prediction, 0.9) OVER w AS hi FROM r WINDOW w AS (PARTITION BY k ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)) SELECT k, date, CASE WHEN n >= 20 THEN round(prediction + lo, 5) END AS lower, CASE WHEN n >= 20 THEN round(prediction + hi, 5) END AS upper FROM q")
def wf11_moving_band(spark, d):
    p = predictions(spark, d).withColumn("resid", F.col("actual") - F.col("prediction"))
    return rounded(features.moving_band(p, K, "resid", "prediction", 52).select("k", "date", "lower", "upper"), 5)


@query(f"WITH {PRED}, m AS (SELECT k, date, origin, prediction, abs(origin - lag(origin) OVER (PARTITION BY k ORDER BY date)) AS m FROM r), q AS (SELECT *, greatest(0.1, 2 * quantile_cont(m, 0.995) OVER (PARTITION BY k ORDER BY date ROWS 51 PRECEDING)) AS l FROM m) SELECT k, date, coalesce(abs(prediction - origin) > l, false) AS guarded FROM q")
def wf12_change_guard(spark, d):
    return features.change_guard(predictions(spark, d), K, "origin", "prediction", 52).select("k", "date", "guarded")


@query(f"WITH {PANEL}, n AS (SELECT date, avg(price) AS nat FROM p GROUP BY 1), rg AS (SELECT n_regionkey AS region, date, avg(price) AS r FROM p JOIN nation ON n_nationkey = k GROUP BY 1, 2), s AS (SELECT p.k, p.date, p.price - n.nat AS s, rg.r - n.nat AS ps FROM p JOIN n ON n.date = p.date JOIN nation ON n_nationkey = p.k JOIN rg ON rg.region = n_regionkey AND rg.date = p.date), z AS (SELECT *, lag(ps, 3) OVER (PARTITION BY k ORDER BY date) AS p3, count(s) OVER w AS n, avg(s) OVER w AS m, stddev_samp(s) OVER w AS sd, lag(s) OVER (PARTITION BY k ORDER BY date) AS l FROM s WINDOW w AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT k, date, round(s, 5) AS spread, round(s - l, 5) AS spread_d, CASE WHEN n >= 52 THEN round((s - m) / sd, 5) + 0.0 END AS spread_z, round(p3, 5) + 0.0 AS producer_l3 FROM z")
def wf8_regional_features(spark, d):
    """The producer's spread is that of the series' region."""
    p = panel(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region")), "k")
    nat = p.groupBy("date").agg(F.avg("price").alias("nat"))
    region = p.groupBy("region", "date").agg(F.avg("price").alias("r"))
    x = p.join(nat, "date").join(region, ["region", "date"]).withColumn("ps", F.col("r") - F.col("nat"))
    f = features.regional_features(x, K, "price", "nat", "ps", 52)
    return f.select("k", "date", (F.round("producer_l3", 5) + 0.0).alias("producer_l3"), F.round("spread", 5).alias("spread"), F.round("spread_d", 5).alias("spread_d"), (F.round("spread_z", 5) + 0.0).alias("spread_z"))


@query(f"WITH {PANEL}, e AS (SELECT k, date, coalesce((datediff('day', lag(date) OVER (PARTITION BY k ORDER BY date), date) > 56)::INT, 1) AS n FROM p WHERE price > 2500) SELECT k, date, sum(n) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM e")
def wf14_episodes(spark, d):
    return features.episodes(panel(spark, d), K, F.col("price") > 2500).select("k", "date", "episode")


@query(f"WITH {PRED}, e AS (SELECT k, sqrt(avg((prediction - actual) ** 2) OVER w / avg((origin - actual) ** 2) OVER w) AS r, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY k ORDER BY date ROWS 12 PRECEDING)) SELECT k, round(max(r) FILTER (n >= 13), 6) AS worst_ratio FROM e GROUP BY k")
def wf18_worst_rolling_ratio(spark, d):
    p = predictions(spark, d).withColumns({"a": F.col("prediction") - F.col("actual"), "b": F.col("origin") - F.col("actual")})
    return rounded(features.worst_rolling_ratio(p, K, "a", "b"))


@query(f"WITH {PANEL} SELECT p.k, p.date, p.price FROM p ANTI JOIN (SELECT DISTINCT o_orderdate::DATE AS date FROM orders) o ON o.date = p.date")
def jn8_require_coverage(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return align.require_coverage(panel(spark, d).select("k", "date", "price"), o, ["date"])


@query(f"WITH {PANEL}, f AS (SELECT k, date, lead(date, 4) OVER (PARTITION BY k ORDER BY date) AS t FROM p) SELECT k, date FROM f WHERE t IS NOT NULL AND NOT t BETWEEN DATE '1997-01-06' AND DATE '1997-03-31'")
def prj7_drop_targets_in_gap(spark, d):
    return prep.drop_targets_in_gap(panel(spark, d), K, "date", 4, "1997-01-06", "1997-03-31").select("k", "date")


@query(f"WITH {COST}, s AS (SELECT k, date, cost, CASE WHEN k % 2 = 0 THEN stations END AS half FROM x) SELECT k, date, last_value(cost IGNORE NULLS) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING) AS cost FROM s")
def prj7_keep_covered_columns(spark, d):
    """A column that half the series lack is dropped; the other is filled forward."""
    x = with_cost(spark, d).select("k", "date", "cost", F.when(F.col("k") % 2 == 0, F.col("stations")).alias("half"))
    return prep.keep_covered_columns(x, K, "date", ["cost", "half"])


@query(f"WITH {PRED}, x AS (SELECT origin, prediction, actual AS price_now, target_date, abs(actual) AS target_price, actual FROM r), c AS (SELECT unnest(['origin', 'prediction', 'price_now', 'target_price']) AS \"column\", unnest([avg((origin = actual)::INT::DOUBLE), avg((prediction = actual)::INT::DOUBLE), avg((price_now = actual)::INT::DOUBLE), avg((target_price = actual)::INT::DOUBLE)]) AS share FROM x) SELECT \"column\", \"column\" IN ('price_now', 'target_price') AS leaks, round(share, 6) AS equal_share, share > 0.95 AS equals_target FROM c")
def prj11_leak_check(spark, d):
    """Features of the forecasts, two of which hold the target itself under names that say so."""
    x = predictions(spark, d).select("origin", "prediction", F.col("actual").alias("price_now"), F.abs("actual").alias("target_price"), "actual")
    return rounded(prep.leaking_columns(x, ["origin", "prediction", "price_now", "target_price"], "actual"))


@query("WITH e AS (SELECT event_type AS k, value AS v, event_id % 2 AS h FROM events), q AS (SELECT k, quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM e WHERE h = 0 GROUP BY k), b AS (SELECT e.k, h, CASE WHEN v = q.e[6] THEN 5 ELSE len(list_filter(q.e, lambda x: x <= v)) END AS bin FROM e JOIN q ON q.k = e.k WHERE v BETWEEN q.e[1] AND q.e[6]), c AS (SELECT k, h, bin, count(*) AS c FROM b GROUP BY 1, 2, 3), s AS (SELECT *, c / sum(c) OVER (PARTITION BY k, h) AS s FROM c), g AS (SELECT k, unnest(range(1, 6)) AS bin FROM q), j AS (SELECT g.k, greatest(coalesce(a.s, 0), 1e-6) AS p, greatest(coalesce(z.s, 0), 1e-6) AS q FROM g LEFT JOIN s a ON a.k = g.k AND a.bin = g.bin AND a.h = 0 LEFT JOIN s z ON z.k = g.k AND z.bin = g.bin AND z.h = 1) SELECT k, round(sum((q - p) * ln(q / p)), 6) AS psi FROM j GROUP BY k")
def ag12_psi(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("k"), F.col("value").alias("v"), (F.col("event_id") % 2).alias("h"))
    return rounded(score.psi(e.filter("h = 0"), e.filter("h = 1"), "v", K, 5))
