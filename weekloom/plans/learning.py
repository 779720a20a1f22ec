"""Registered queries: forecasts and online learning; SQL where it can say the same."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weekloom.operators import align, features, learn
from weekloom.plans.alignment import SPREAD, spread
from weekloom.plans.queries import K, PANEL, PRED, panel, predictions, query, rounded, table


def supervised(spark, d):
    """Forecast rows with three features known at the origin."""
    p = predictions(spark, d)
    w = features.by_date(K)
    return p.withColumns({"change": F.col("actual") - F.col("origin"), "gap": F.col("origin") - F.col("prediction"), "move": F.col("origin") - F.lag("origin", 1).over(w), "moved2": F.lag("origin", 1).over(w) - F.lag("origin", 2).over(w)}).drop("prediction")


XS = ["gap", "move", "moved2"]


@query()
def ml2_arima_walk_forward(spark, d):
    """On the weekly grid: weeks without a price are missing values, which the filter skips."""
    grid = align.weekly_grid(panel(spark, d).select("k", "date", "price"), K)
    return rounded(learn.arima_walk_forward(grid, K, "price"), 3)


@query()
def ml3_arimax_walk_forward(spark, d):
    grid = align.weekly_grid(panel(spark, d).withColumn("n", F.col("stations").cast("double")).drop("stations"), K)
    return rounded(learn.arimax_walk_forward(grid, K, "price", ["n"]), 3)


@query()
def ml4_ridge_walk_forward(spark, d):
    return rounded(learn.walk_forward(supervised(spark, d), K, XS, "change", learn.ridge()), 4)


@query(f"WITH {PRED}, i AS (SELECT k, date, target_date, origin - prediction AS x, row_number() OVER w AS i, regr_slope(actual - origin, origin - prediction) OVER v AS b, regr_intercept(actual - origin, origin - prediction) OVER v AS a FROM r WINDOW w AS (PARTITION BY k ORDER BY date), v AS (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING)), n AS (SELECT a.k, a.date, a.x, (SELECT count(*) FROM i b WHERE b.k = a.k AND b.target_date <= a.date) AS n FROM i a) SELECT n.k, n.date, CASE WHEN n >= 52 THEN round(i.a + i.b * n.x, 3) + 0.0 END AS prediction FROM n LEFT JOIN i ON i.k = n.k AND i.i = n.n")
def ml4_one_feature(spark, d):
    """One feature and no penalty, refitted at every origin: least squares on all known labels."""
    x = learn.walk_forward(supervised(spark, d), K, ["gap"], "change", learn.ridge(0.0), 52, 1)
    return x.select("k", "date", (F.round("prediction", 3) + 0.0).alias("prediction"))


@query()
def ml5_boosted_trees(spark, d):
    """Refit every 52 weeks, from the first week with 1,000 known labels to the last one (every 26 weeks took 98 s at sf0.01)."""
    x = supervised(spark, d)
    return learn.boosted_trees(x, XS, "change", learn.refit_epochs(x, 52, 1000)).select("k", "date", F.round("prediction", 4).alias("prediction"))


@query()
def ml7_ecm_walk_forward(spark, d):
    x = supervised(spark, d).withColumns({"size": F.abs("move"), "vol": F.abs("gap")})
    return rounded(learn.ecm_walk_forward(x, K, XS, "change", "origin", drivers=["size", "vol"]).select("k", "date", "prediction", "fallback", "sigma", "lower", "upper"), 4)


@query(f"WITH {PRED}, i AS (SELECT k, date, target_date, actual - origin AS c, row_number() OVER w AS i, sum(actual - origin) OVER (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM r WINDOW w AS (PARTITION BY k ORDER BY date)), n AS (SELECT a.k, a.date, (SELECT count(*) FROM i b WHERE b.k = a.k AND b.target_date <= a.date) AS n FROM i a) SELECT n.k, n.date, CASE WHEN n >= 52 THEN round(s / n, 5) + 0.0 END AS prediction, CASE WHEN n >= 52 THEN n::DOUBLE END AS trained FROM n LEFT JOIN i ON i.k = n.k AND i.i = n.n")
def ml6_walk_forward(spark, d):
    """The runner with a callable that predicts the mean of all known changes, refitted at every origin."""

    def mean(x, y):
        return lambda q: np.full(len(q), y.mean())

    x = learn.walk_forward(supervised(spark, d), K, ["origin"], "change", mean, 52, 1)
    return x.select("k", "date", (F.round("prediction", 5) + 0.0).alias("prediction"), "trained")


@query(f"""WITH {PANEL}, i AS (SELECT k, date, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS origin, lead(date, 4) OVER (PARTITION BY k ORDER BY date) AS target_date FROM p)
SELECT k, origin::INT AS origin, date, target_date FROM i WHERE origin >= 51 AND target_date IS NOT NULL""")
def ml6_origins(spark, d):
    return learn.origins(panel(spark, d), K, 52, 4)


@query()
def ml8_conditional_interval(spark, d):
    p = predictions(spark, d).withColumn("gap", F.abs(F.col("prediction") - F.col("origin")))
    return rounded(learn.conditional_interval(p, K, "actual", "prediction", ["gap"]), 4)


@query(f"""WITH {SPREAD}, l AS (SELECT *, lag(spread) OVER (PARTITION BY k ORDER BY date) AS x FROM sp), s AS (SELECT k, date, nat, spread, count(x) OVER w AS n, regr_slope(spread - x, x) OVER w AS b, regr_intercept(spread - x, x) OVER w AS a, regr_syy(spread - x, x) OVER w AS yy, regr_sxy(spread - x, x) OVER w AS xy FROM l WINDOW w AS (PARTITION BY k ORDER BY date ROWS UNBOUNDED PRECEDING)),
f AS (SELECT k, date, nat, spread, a, CASE WHEN n >= 52 THEN greatest(0, least(1, -b)) END AS kappa, 4 * sqrt(greatest(0, yy - b * xy) / (n - 1)) AS top FROM s)
SELECT k, date, round(kappa, 5) AS kappa, round(nat + spread + CASE WHEN kappa > 0 THEN greatest(-top, least(top, a - kappa * spread)) ELSE 0 END, 3) AS prediction FROM f""")
def ml9_spread_walk_forward(spark, d):
    x = learn.spread_walk_forward(spread(spark, d), K, "spread", "nat")
    return x.select("k", "date", F.round("kappa", 5).alias("kappa"), F.round("prediction", 3).alias("prediction"))


@query()
def ml9_anchored_spread(spark, d):
    """The anchor: how far the series' region lies from the mean of all, against its own past. Weeks weigh by stations, reversion is pooled."""
    x = spread(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region")), "k")
    r = x.groupBy("region", "date").agg(F.avg("spread").alias("r"))
    r = r.withColumn("anchor", (F.col("r") - features.past(F.avg, "r", ["region"], 12)) / F.nullif(features.past(F.stddev_samp, "r", ["region"], 12), F.lit(0.0))).drop("r")
    one = learn.spread_walk_forward(x, K, "spread", "nat").groupBy("date").agg(F.avg("kappa").alias("pooled"))
    x = x.withColumn("stations", F.col("stations").cast("double")).join(r, ["region", "date"]).join(one, "date")
    return rounded(learn.anchored_spread_walk_forward(x, K, "spread", "nat", "anchor", "stations", "pooled", 0.5), 3)


@query()
def ml11_adaptive_conformal(spark, d):
    """The scale is the mean size of the last eight moves."""
    x = predictions(spark, d).withColumn("move", F.abs(F.col("origin") - F.lag("origin", 1).over(features.by_date(K))))
    x = x.withColumn("scale", F.avg("move").over(features.by_date(K).rowsBetween(-7, 0)))
    return rounded(learn.adaptive_conformal(x, K, "actual", "prediction", "scale"), 4)


@query(f"""WITH RECURSIVE {PANEL}, i AS (SELECT k, date, price, row_number() OVER (PARTITION BY k ORDER BY date) AS i FROM p),
h AS (SELECT k, i, date, 1::DOUBLE AS n, price AS mean, -5.0::DOUBLE AS s, -5.0::DOUBLE AS low FROM i WHERE i = 1
  UNION ALL SELECT i.k, i.i, i.date, g.n + 1, g.mean + (price - g.mean) / (g.n + 1), g.s + price - (g.mean + (price - g.mean) / (g.n + 1)) - 5, least(g.low, g.s + price - (g.mean + (price - g.mean) / (g.n + 1)) - 5)
  FROM (SELECT k, i, CASE WHEN s - low > 3000 THEN 0 ELSE n END AS n, CASE WHEN s - low > 3000 THEN 0 ELSE mean END AS mean, CASE WHEN s - low > 3000 THEN 0 ELSE s END AS s, CASE WHEN s - low > 3000 THEN 0 ELSE low END AS low FROM h) g JOIN i ON i.k = g.k AND i.i = g.i + 1)
SELECT k, date, round(s - low, 4) AS path, (s - low > 3000)::INT::DOUBLE AS changed FROM h""")
def ml12_page_hinkley(spark, d):
    return rounded(learn.page_hinkley(panel(spark, d), K, "price", 5.0, 3000.0), 4)


@query()
def ml13_online_learner(spark, d):
    return rounded(learn.online_learner(supervised(spark, d), K, XS, "change"), 3)


@query()
def ml13_fixed_beta(spark, d):
    return rounded(learn.online_learner(supervised(spark, d), K, XS, "change", steady=True), 3)


@query()
def ml14_evaluate_candidates(spark, d):
    x = supervised(spark, d)
    folds = x.groupBy(F.year("date").alias("fold_id")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    return rounded(learn.evaluate_candidates(x, K, XS, "change", [0.1, 1.0, 10.0], folds), 3)


SETS = {"price": ["origin"], "lags": ["move", "moved2"], "dynamics": ["gap", "gap2", "move"]}
TARGETS = {"level": "actual", "delta": "change"}


def with_sets(spark, d):
    return supervised(spark, d).withColumn("gap2", F.col("origin") - F.avg("origin").over(features.by_date(K).rowsBetween(-7, 0)))


@query()
def ml14_evaluate_learners(spark, d):
    """Three seeds and three drawn candidates, every second year a fold."""
    x = with_sets(spark, d)
    y = F.year("date")
    folds = x.groupBy((y - y % 2).alias("fold_id")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    return rounded(learn.evaluate_learners(x, K, SETS, TARGETS, "origin", learn.candidate_grid(spark, 3), folds), 2)


@query()
def ml15_candidate_search(spark, d):
    return rounded(learn.search_learner(with_sets(spark, d), K, SETS, TARGETS, "origin", learn.candidate_grid(spark, 6), F.col("date") >= "1998-01-05"), 1)


@query()
def ml16_residual_hybrid(spark, d):
    x = supervised(spark, d)
    return learn.residual_hybrid(x, K, XS, "actual", "origin").select("k", "date", F.round("prediction", 3).alias("prediction"))


@query()
def ml16_learned_grid(spark, d):
    x = learn.corrections(supervised(spark, d), K, XS, "actual", "origin").withColumn("year", F.year("date"))
    return rounded(learn.hybrid_grid(x, "actual", "origin", "correction", [0.25, 0.5, 1.0], [0.02, 0.05, None], "year"), 2)


GRID = ", ".join(f"({w}::DOUBLE, {t}::DOUBLE)" for w in (0.25, 0.5, 1.0) for t in (0.02, 0.05, "NULL"))


@query(f"WITH {PRED}, x AS (SELECT year(date) AS year, actual, origin, prediction - origin AS c FROM r), g AS (SELECT * FROM (VALUES {GRID}) t(weight, \"limit\")), e AS (SELECT year, weight, \"limit\", origin - actual AS b, origin + CASE WHEN \"limit\" IS NULL THEN weight * c ELSE greatest(-\"limit\" * abs(origin), least(\"limit\" * abs(origin), weight * c)) END - actual AS e FROM x CROSS JOIN g WHERE actual IS NOT NULL AND origin IS NOT NULL) SELECT year, weight, \"limit\", count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(sqrt(avg(e * e) / nullif(avg(b * b), 0)), 4) AS rmse_ratio FROM e GROUP BY 1, 2, 3")
def ml16_hybrid_grid(spark, d):
    """The grid on a correction that needs no learner: towards the registered forecast."""
    x = predictions(spark, d).withColumns({"correction": F.col("prediction") - F.col("origin"), "year": F.year("date")})
    return rounded(learn.hybrid_grid(x, "actual", "origin", "correction", [0.25, 0.5, 1.0], [0.02, 0.05, None], "year"), 4)


@query(f"WITH {PRED}, a AS (SELECT k, min(origin) AS a, max(origin) AS b FROM r WHERE date < DATE '1998-01-05' GROUP BY k), z AS (SELECT r.k, date, (origin - a) / (b - a) AS z FROM r JOIN a ON a.k = r.k) SELECT k, date, round(greatest(0, least(1, z)), 8) AS scaled, z < 0 OR z > 1 AS clipped FROM z")
def ml17_minmax_scale(spark, d):
    return learn.minmax_scale(predictions(spark, d), K, "origin", F.col("date") < "1998-01-05").select("k", "date", F.round("scaled", 8).alias("scaled"), "clipped")


@query(f"WITH {PRED}, a AS (SELECT k, quantile_cont(origin, 0.25) AS a, median(origin) AS m, quantile_cont(origin, 0.75) AS b FROM r WHERE date < DATE '1998-01-05' GROUP BY k) SELECT r.k, date, round(atan((origin - m) / (b - a)) * 2 / pi(), 8) + 0.0 AS scaled FROM r JOIN a ON a.k = r.k")
def ml17_robust_scale(spark, d):
    return learn.robust_scale(predictions(spark, d), K, "origin", F.col("date") < "1998-01-05").select("k", "date", (F.round("scaled", 8) + 0.0).alias("scaled"))


@query("WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL), g AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS point FROM g GROUP BY 1) SELECT vec_id, c.label AS landmark, round(exp(-list_sum(list_transform(range(1, len(point) + 1), lambda i: (embedding[i]::DOUBLE - point[i]) ** 2)) / 2), 6) AS kernel FROM embeddings CROSS JOIN c")
def ml18_rbf_features(spark, d):
    e = table(spark, d, "embeddings")
    means = e.filter("label is not null").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    marks = means.groupBy(F.col("label").alias("landmark")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p")).select("landmark", F.transform("p", lambda r: r["x"]).alias("point"))
    return rounded(learn.rbf_features(e, "vec_id", "embedding", marks, 1.0))


@query(f"WITH {PRED}, m AS (SELECT *, abs(origin - lag(origin) OVER (PARTITION BY k ORDER BY date)) AS m, actual - prediction AS e FROM r), q AS (SELECT *, greatest(0.1, 2 * quantile_cont(m, 0.995) OVER (PARTITION BY k ORDER BY date ROWS 155 PRECEDING)) AS l, CASE WHEN count(e) OVER w >= 20 THEN quantile_cont(e, 0.1) OVER w END AS lo, CASE WHEN count(e) OVER w >= 20 THEN quantile_cont(e, 0.9) OVER w END AS hi FROM m WINDOW w AS (PARTITION BY k ORDER BY date ROWS BETWEEN 156 PRECEDING AND 1 PRECEDING)), g AS (SELECT *, CASE WHEN abs(prediction - origin) > l THEN origin ELSE prediction END AS pt FROM q) SELECT k, date, round(pt / 3.785411784, 5) AS point, round(least(pt, pt + lo) / 3.785411784, 5) AS p10, round(greatest(pt, pt + hi) / 3.785411784, 5) AS p90 FROM g")
def ml20_release_forecast(spark, d):
    p = predictions(spark, d).withColumn("resid", F.col("actual") - F.col("prediction"))
    x = learn.release_forecast(p, K, "origin", "prediction")
    return x.select("k", "date", *[F.round(F.col(c) / 3.785411784, 5).alias(c) for c in ("point", "p10", "p90")])
