"""Forecasts against numpy, held-out accuracy, and causality: changing later rows never changes earlier forecasts."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import learn

DAY = dt.date(2020, 1, 6)


def frame(spark, rows, names):
    """rows: tuples of doubles, one a week, for one series; the target is known a week later."""
    data = [(1, DAY + dt.timedelta(days=7 * i), DAY + dt.timedelta(days=7 * i + 7), *(None if v is None else float(v) for v in r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "k int, date date, target_date date, " + ", ".join(f"{n} double" for n in names))


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def regression(seed=3, n=120):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    return x, 2 * x[:, 0] - x[:, 1] + 0.1 * r.normal(size=n)


def test_ridge_equals_a_direct_solution_on_known_labels(spark):
    x, y = regression()
    rows = [(*a, b) for a, b in zip(x, y)]
    rows[5] = (None, 1.0, 2.0)
    got = column(learn.walk_forward(frame(spark, rows, "abc"), ["k"], ["a", "b"], "c", learn.ridge(1.0), 30, 1), "prediction")
    use = [j for j in range(100) if j != 5]  # the label of row 99 is known at row 100
    m, s = x[use].mean(0), x[use].std(0)
    z = (x[use] - m) / s
    b = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y[use] - y[use].mean()))
    assert got[100] == pytest.approx((x[100] - m) / s @ b + y[use].mean())
    assert got[5] is None and got[10] is None


def test_huber_ignores_outliers():
    x, y = regression()
    y[::10] += 50
    f = learn.huber()(x, y)
    assert abs(f(np.array([[1.0, 0.0]]))[0] - f(np.array([[0.0, 0.0]]))[0] - 2) < 0.1


def ar1(seed, n=400):
    r, y = np.random.default_rng(seed), [0.0]
    for _ in range(n):
        y.append(0.6 * y[-1] + r.normal())
    return np.array(y)


def test_conformal_bands_cover(spark):
    r = np.random.default_rng(2)
    y = r.normal(size=400) * np.where(np.arange(400) > 200, 3, 1)
    df = frame(spark, [(v, 0.0, abs(s)) for v, s in zip(y, np.where(np.arange(400) > 200, 3, 1))], "yhs")
    for band in (learn.adaptive_conformal(df, ["k"], "y", "h"), learn.conditional_interval(df, ["k"], "y", "h", ["s"])):
        x = df.join(band, ["k", "date"]).filter("lower is not null")
        assert 0.72 < x.agg(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))).first()[0] < 0.88


def test_page_hinkley_against_a_loop(spark):
    v = [0.0] * 20 + [5.0] * 10
    got = column(learn.page_hinkley(frame(spark, [(a,) for a in v], "a"), ["k"], "a", 0.1, 8.0), "changed")
    n = mean = s = low = 0.0
    for i, a in enumerate(v):
        n, mean = n + 1, mean + (a - mean) / (n + 1)
        s += a - mean - 0.1
        low = min(low, s)
        if s - low > 8:
            break
    assert i == got.index(1.0)


def test_online_learner_learns_a_curve(spark):
    r = np.random.default_rng(5)
    x = r.uniform(-2, 2, 300)
    y = np.sin(2 * x)
    # the default width is half a period of this curve, too wide to follow it
    got = learn.online_learner(frame(spark, list(zip(x, y)), "ab"), ["k"], ["a"], "b", width=0.5, novelty=0.01)
    p = np.array(column(got, "prediction")[150:], float)
    assert np.abs(p - y[150:]).mean() < 0.4 * np.abs(y[150:]).mean()


def test_later_rows_do_not_change_earlier_forecasts(spark):
    x, y = regression(n=90)
    a = frame(spark, [(*p, q) for p, q in zip(x, y)], "abc")
    late = F.col("date") > DAY + dt.timedelta(days=7 * 70)
    b = a.withColumns({n: F.when(late, 99.0).otherwise(F.col(n)) for n in "abc"})
    for run in (
        lambda d: learn.walk_forward(d, ["k"], ["a", "b"], "c", learn.ridge(), 20, 5), lambda d: learn.arima_walk_forward(d, ["k"], "c", min_train=20),
        lambda d: learn.arimax_walk_forward(d, ["k"], "c", ["a"], min_train=20), lambda d: learn.adaptive_conformal(d, ["k"], "c", "a"),
        lambda d: learn.online_learner(d, ["k"], ["a", "b"], "c"), lambda d: learn.ecm_walk_forward(d, ["k"], ["a"], "b", "c", min_train=20).select("date", "prediction"),
        lambda d: learn.spread_walk_forward(d, ["k"], "a", "b", 20).select("date", "prediction"), lambda d: learn.residual_hybrid(d, ["k"], ["a"], "c", "b").select("date", "prediction"),
    ):
        early = lambda d: [tuple(r) for r in run(d).filter(~late).orderBy("date").collect()]  # noqa: B023, E731
        assert early(a) == early(b)


def test_boosted_trees_on_held_out_rows(spark):
    x, y = regression(n=300)
    df = frame(spark, [(*p, q) for p, q in zip(x, y)], "abc")
    got = learn.boosted_trees(df, ["a", "b"], "c", [("2024-01-01", "2030-01-01")], rounds=10).select("c", "prediction").collect()
    e = np.mean([abs(r["c"] - r["prediction"]) for r in got])
    assert len(got) > 50 and e < 0.6 * np.mean([abs(r["c"]) for r in got])


def test_candidates_by_fold_equal_numpy(spark):
    x, y = regression(n=80)
    df = frame(spark, [(*p, q) for p, q in zip(x, y)], "abc")
    folds = spark.createDataFrame([(1, DAY + dt.timedelta(days=7 * 50), DAY + dt.timedelta(days=7 * 69))], "fold_id int, start_date date, end_date date")
    got = {r["candidate"]: (r["mae"], r["n"]) for r in learn.evaluate_candidates(df, ["k"], ["a", "b"], "c", [0.1, 10.0], folds).collect()}
    want = np.abs(learn.ridge(10.0)(x[:50], y[:50])(x[50:70]) - y[50:70]).mean()
    assert got[1] == (pytest.approx(want), 20) and len(got) == 2


def test_empty_series(spark):
    e = frame(spark, [], "abc")
    for got in (learn.walk_forward(e, ["k"], ["a"], "c", learn.ridge()), learn.arima_walk_forward(e, ["k"], "c"), learn.page_hinkley(e, ["k"], "a")):
        assert got.count() == 0
    missing = frame(spark, [(None, None, None)] * 60, "abc")
    assert column(learn.arima_walk_forward(missing, ["k"], "c"), "prediction") == [None] * 60
    assert column(learn.online_learner(missing, ["k"], ["a"], "c"), "prediction") == [None] * 60


def test_spread_returns_to_its_own_level(spark):
    r, s = np.random.default_rng(8), [3.0]
    for _ in range(149):
        s.append(s[-1] - 0.3 * (s[-1] - 5.0) + 0.1 * r.normal())
    s = np.array(s)
    got = learn.spread_walk_forward(frame(spark, [(v, 100.0) for v in s], "ab"), ["k"], "a", "b", 52)
    kappa, prediction = np.array(column(got, "kappa")[60:], float), column(got, "prediction")
    a = np.column_stack([np.ones(100), s[:100]])
    b = np.linalg.lstsq(a, np.diff(s)[:100], rcond=None)[0]
    assert kappa[40] == pytest.approx(-b[1]) and prediction[100] == pytest.approx(100 + s[100] + b[0] + b[1] * s[100])
    assert column(got, "kappa")[:52] == [None] * 52 and prediction[10] == pytest.approx(100 + s[10])


def test_anchored_spread_against_numpy(spark):
    r = np.random.default_rng(9)
    z, size, s = r.normal(size=120), r.integers(5, 60, 120).astype(float), [0.0]
    for i in range(119):
        s.append(s[-1] - 0.3 * (s[-1] - (1.0 + 0.5 * z[i])) + 0.02 * r.normal())
    s = np.array(s)
    rows = [[v, 10.0, u, w, 0.1] for v, u, w in zip(s, z, size)]
    rows[90][2] = None  # no anchor: falls back to the level
    df = frame(spark, rows, "abcde")
    got = learn.anchored_spread_walk_forward(df, ["k"], "a", "b", "c", "d", "e", 0.75, 52, most_sigmas=100.0)
    use = np.arange(1, 81)
    w = np.sqrt(np.clip(size[use] / np.median(size[use]), 0.25, 4.0))
    m = np.column_stack([np.ones(80), s[use - 1], z[use - 1]])
    b = np.linalg.lstsq(m * w[:, None], (s[use] - s[use - 1]) * w, rcond=None)[0]
    kappa = 0.75 * -b[1] + 0.25 * 0.1
    assert column(got, "kappa")[80] == pytest.approx(kappa)
    assert column(got, "prediction")[80] == pytest.approx(10 + s[80] + kappa * (b[0] / kappa + b[2] / kappa * z[80] - s[80]))
    at = {r["date"]: r for r in got.collect()}[DAY + dt.timedelta(days=7 * 90)]
    assert at["prediction"] == pytest.approx(10 + s[90] + at["kappa"] * (at["level"] - s[90]))
    assert column(got, "prediction")[20] is None
    cut = learn.anchored_spread_walk_forward(df, ["k"], "a", "b", "c", "d", "e", 0.75, 52)
    top = 4 * np.std((s[use] - s[use - 1]) - m @ b, ddof=1)
    assert column(cut, "prediction")[80] == pytest.approx(10 + s[80] + top)  # the rise above is beyond four deviations
    assert learn.anchored_spread_walk_forward(df.limit(0), ["k"], "a", "b", "c").count() == 0


def test_p_values(spark):
    from weekloom.operators import score

    # fixed values: quantiles of the normal and of t with 1, 2, 9 and 10 degrees that leave 5 % outside
    rows = [(1.959963984540054, 12.706204736432095, 1), (1.959963984540054, 4.302652729911275, 2), (-1.959963984540054, 2.2621571628540993, 9), (0.0, -2.2281388519649385, 10), (12.0, 0.0, 10), (None, None, 0)]
    got = spark.createDataFrame(rows, "z double, t double, f int").select(score.normal_p(F.col("z")), score.t_p(F.col("t"), F.col("f"))).collect()
    assert [g[0] for g in got[:5]] == pytest.approx([0.05, 0.05, 0.05, 1.0, 0.0]) and [g[1] for g in got[:5]] == pytest.approx([0.05] * 4 + [1.0])
    assert tuple(got[5]) == (None, None)


def test_candidate_grid_equals_hashlib(spark):
    import hashlib

    got = learn.candidate_grid(spark, 20, 2, 7).orderBy("candidate").collect()
    assert len(got) == 23 and [r["candidate"] for r in got[-3:]] == ["seed_dynamics", "seed_lags", "seed_price"]
    for i, r in enumerate(got[:20]):
        want = {c: v[int(hashlib.md5(f"7|2|{i}|{c}".encode()).hexdigest()[:8], 16) % len(v)] for c, v in learn.CHOICES.items()}
        assert {c: r[c] for c in want} == pytest.approx(want)
        assert (r["feature_set"], r["target_mode"]) == (learn.FEATURE_SETS[i % 6 // 2], learn.TARGET_MODES[i % 2])
    assert learn.candidate_grid(spark, 0).count() == 3
    with pytest.raises(ValueError):
        learn.candidate_grid(spark, -1)


def test_candidate_search_equals_single_runs(spark):
    x, y = regression(n=80)
    df = frame(spark, [(*p, q, q + 10, 10.0) for p, q in zip(x, y)], "abcde")
    grid = learn.candidate_grid(spark, 2)
    sets = {"price": ["a"], "lags": ["b"], "dynamics": ["a", "b"]}
    start = F.col("date") >= DAY + dt.timedelta(days=7 * 40)
    got = {r["candidate"]: r for r in learn.search_learner(df, ["k"], sets, {"level": "d", "delta": "c"}, "e", grid, start).collect()}
    assert len(got) == 5
    for c in grid.collect():
        delta = c["target_mode"] == "delta"
        one = learn.online_learner(df, ["k"], sets[c["feature_set"]], "c" if delta else "d", c["width"], c["novelty"], c["most"], c["ridge"], c["radius"])
        e = np.abs(np.array(column(one, "prediction")[40:], float) + (10 if delta else 0) - (y[40:] + 10))
        assert got[c["candidate"]]["mae"] == pytest.approx(e.mean()) and got[c["candidate"]]["n"] == 40


def test_text_pressure(spark):
    import collections

    from weekloom.operators import text

    day = lambda i: DAY + dt.timedelta(days=7 * i)
    r = np.random.default_rng(4)
    labels = [int(v) for v in r.integers(-1, 2, 120)]
    say = {-1: "Preço CAI, cai forte", 0: "sem mudança aqui", 1: "preco sobe sobe"}
    docs = [(1, day(i), say[v]) for i, v in enumerate(labels) if i != 100] + [(1, day(3), None), (1, day(4), ""), (1, day(5), "a 1"), (1, day(119), "longo " * 50_000)]
    d = spark.createDataFrame(docs, "k int, date date, text string")
    grams = text.gram_counts(d, ["k", "date"], "text")
    weeks = {x["date"]: sorted(n for _, n in x["grams"]) for x in grams.collect()}
    words = ["preco", "cai", "cai", "forte"]
    assert weeks[day(labels.index(-1))] == sorted(collections.Counter([*words, *map(" ".join, zip(words, words[1:]))]).values())
    assert day(100) not in weeks and max(weeks[day(119)]) == 50_000
    rows = spark.createDataFrame([(1, day(i), day(i + 1), None if i == 60 else v) for i, v in enumerate(labels)], "k int, date date, target_date date, label int")
    run = lambda x, g: text.text_pressure(x, ["k"], g, "label").orderBy("date").collect()
    got = run(rows, grams)
    assert [g["trained"] for g in got[:3]] == [0, 1, 2] and got[119]["trained"] == 118
    assert got[0]["p_up"] == pytest.approx(1 / 3) and got[0]["entropy"] == pytest.approx(1)
    late = [i for i in range(60, 119) if i != 100]
    assert np.mean([got[i]["predicted"] == labels[i] for i in late]) > 0.95
    assert all(g["p_down"] + g["p_neutral"] + g["p_up"] == pytest.approx(1) for g in got)
    turned = run(rows.withColumn("label", F.when(F.col("date") > day(80), -F.col("label")).otherwise(F.col("label"))), grams)
    assert [tuple(g) for g in turned[:82]] == [tuple(g) for g in got[:82]]
    assert run(rows.limit(0), grams) == [] and len(run(rows, grams.limit(0))) == 120


def streamed(spark, tmp_path, batches, make):
    """The rows that a stream gives when its batches arrive one after the other."""
    schema = batches[0].schema
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        x = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        x.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(x.schema).parquet(str(tmp_path / "out")).orderBy("key", "day").collect()


def test_streamed_band_and_learner_equal_the_batch(spark, tmp_path):
    from weekloom.streaming import online

    x, y = regression(n=90)
    x[7, 0] = np.nan
    df = frame(spark, [(None if np.isnan(p[0]) else p[0], p[1], q) for p, q in zip(x, y)], "abc")
    rows = df.select(F.col("k").cast("long").alias("key"), F.col("date").alias("day"), F.col("c").alias("actual"), F.col("b").alias("point"), "a", "b")
    cut = F.col("day") < DAY + dt.timedelta(days=7 * 50)
    again = rows.filter(F.col("day") == DAY + dt.timedelta(days=7 * 20))
    skip = rows.filter(F.col("day") == DAY + dt.timedelta(days=7 * 89)).withColumn("day", F.date_add("day", 21))
    batches = [rows.filter(cut), rows.filter(~cut).unionByName(again).unionByName(skip)]
    got = streamed(spark, tmp_path / "band", batches, online.conformal_stream)
    assert sum(g["rejected"] for g in got) == 2 and len(got) == 92
    want = learn.adaptive_conformal(df, ["k"], "c", "b").orderBy("date").collect()
    good = [g for g in got if not g["rejected"]]
    assert [(g["lower"], g["upper"], g["level"]) for g in good] == [(w["lower"], w["upper"], w["level"]) for w in want]
    assert good[80]["lower"] is not None
    got = streamed(spark, tmp_path / "rules", batches, lambda s: online.learner_stream(s, ["a", "b"], "actual"))
    # a label of the row's own day is known a week later at the latest: the batch learner sees the same labels before each row
    want = column(learn.online_learner(df, ["k"], ["a", "b"], "c"), "prediction")
    assert [g["prediction"] for g in got if not g["rejected"]] == pytest.approx(want, nan_ok=True) and want[60] is not None


def test_conformal_scale_warm_up_and_seed():
    c = learn.Conformal()
    low, high = c.band(10.0, 2.0)
    assert abs(high - 10 - 1.2815515655446004 * 2) < 1e-9 and abs(low + high - 20) < 1e-9  # Gaussian until residuals are there
    c.seed(np.linspace(-1, 3, 41))
    assert c.warm and np.allclose(c.band(0.0, 2.0), (2 * (-1 + 0.1 * 4), 2 * (-1 + 0.9 * 4)))  # signed quantiles times the scale
    for _ in range(200):
        c.learn(1000.0, 0.0, 1.0)
    assert c.bounds[0] <= c.level <= c.bounds[1] and c.clips > 0 and len(c.errors) == c.window


def test_conformal_follows_a_change_of_scale(spark):
    rng = np.random.default_rng(3)
    size = np.where(np.arange(600) < 300, 1.0, 5.0)
    rows = [("a", str(np.datetime64("2000-01-03") + 7 * k), float(e), 0.0, float(s)) for k, (e, s) in enumerate(zip(rng.normal(size=600) * size, size))]
    df = spark.createDataFrame(rows, "k string, date string, y double, h double, s double").selectExpr("k", "to_date(date) AS date", "y", "h", "s")
    got = learn.adaptive_conformal(df, ["k"], "y", "h", "s").join(df, ["k", "date"]).selectExpr("avg(cast(y between lower and upper as double)) AS c", "avg(upper - lower) AS w").first()
    plain = learn.adaptive_conformal(df, ["k"], "y", "h").join(df, ["k", "date"]).selectExpr("avg(cast(y between lower and upper as double)) AS c").first()
    assert abs(got["c"] - 0.8) < 0.04 and abs(plain["c"] - 0.8) < 0.06 and 5 < got["w"] < 10


def test_ecm_band_covers(spark):
    rng = np.random.default_rng(7)
    n = 320
    x, vol = rng.normal(size=n), np.where(np.arange(n) % 40 < 20, 0.2, 1.0)
    change = 0.8 * x + rng.normal(size=n) * vol
    origin = 100 + np.concatenate([[0], np.cumsum(change)[:-1]])
    day = np.datetime64("2000-01-03") + 7 * np.arange(n + 1)
    rows = [("a", str(day[k]), str(day[k + 1]), float(x[k]), float(vol[k]), float(origin[k]), float(change[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "k string, d string, t string, x double, vol double, origin double, change double").selectExpr("k", "to_date(d) AS date", "to_date(t) AS target_date", "x", "vol", "origin", "change")
    got = learn.ecm_walk_forward(df, ["k"], ["x"], "change", "origin", drivers=["vol"]).filter("lower is not null").collect()
    inside = np.mean([r["lower"] <= r["origin"] + r["change"] <= r["upper"] for r in got])
    width = {v: np.mean([r["upper"] - r["lower"] for r in got if r["vol"] == v]) for v in (0.2, 1.0)}
    assert len(got) > 150 and 0.7 < inside < 0.9 and width[1.0] > 2 * width[0.2]
    assert not any(r["fallback"] for r in got)


def test_refit_epochs(spark):
    rows = [(f"2000-01-{3 + 7 * k:02d}",) for k in range(4)] + [("2000-02-07",), ("2000-02-14",)]
    df = spark.createDataFrame(rows, "d string").selectExpr("to_date(d) AS target_date", "date_sub(to_date(d), 7) AS date")
    assert learn.refit_epochs(df, 2, 2) == [("2000-01-10", "2000-01-24"), ("2000-01-24", "2000-02-07"), ("2000-02-07", "2000-02-21")]
    assert learn.refit_epochs(df, 2, 99) == [] and learn.refit_epochs(df.limit(0), 2, 1) == []


def test_rule_learner_beta_merging_and_replacement():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 2))
    y = x[:, 0] + 0.5 * r.normal(size=200)
    known = np.arange(200)
    got = learn.learned(x, y, known, learn.RuleLearner(2, most=5, novelty=0.01))
    assert got["beta"].nunique() > 10 and got["beta"].between(0.05, 0.5).all()
    assert got["action"][0] is None and got["action"][1] == "created" and got["action"].str.startswith("replaced").any()
    assert (got["dictionary"] <= 5 * got["rules"]).all()
    fixed = learn.learned(x, y, known, learn.RuleLearner(2, steady=True))
    assert fixed["beta"].unique() == [0.18] and fixed["action"].str.contains("merged").any()
    # two far groups of rows, one rule each: a beta this high merges nearer ones
    z = np.r_[r.normal(size=(100, 1)) * 0.01, 10 + r.normal(size=(100, 1)) * 0.01][r.permutation(200)]
    model = learn.RuleLearner(1, radius=0.3, beta=0.3, steady=True)
    got = learn.learned(z, np.where(z[:, 0] > 5, 3.0, -1.0), known, model)
    assert len(model.rules) == 2 and model.predict(np.array([10.0])) == pytest.approx(3, abs=0.01) and model.predict(np.array([0.0])) == pytest.approx(-1, abs=0.01)
    # a rule without an error beyond the tolerance lowers beta to its bound, one with raises it
    same = learn.learned(x, np.full(200, 2.0), known, learn.RuleLearner(2))
    assert same["beta"].iloc[-1] == 0.05 and same["prediction"].iloc[-1] == pytest.approx(2)
    assert learn.learned(x, y, known, learn.RuleLearner(2, tolerance=0.0))["beta"].iloc[-1] == 0.5
    for bad in ({"beta": 0.6}, {"grow": 1.0}, {"width": 0.0}, {"most": 0}):
        with pytest.raises(ValueError):
            learn.RuleLearner(2, **bad)


def test_default_learner_follows_a_fast_curve():
    r = np.random.default_rng(5)
    x = r.uniform(-2, 2, (300, 1))
    y = np.sin(2 * x[:, 0])
    p = learn.learned(x, y, np.arange(300), learn.RuleLearner(1))["prediction"].to_numpy()
    assert np.abs(p - y)[150:].mean() < 0.3 * np.abs(y[150:]).mean()


def test_series_are_dealt_to_all_partitions(spark):
    rows = spark.range(64).select((F.col("id") % 16).cast("int").alias("k"), F.lit(DAY).alias("date"), F.col("id").cast("double").alias("v"))
    sorted_ = rows.withColumn("v", F.sum("v").over(learn.by_date(["k"])))  # partitioned by the key already
    got = learn.page_hinkley(sorted_, ["k"], "v").select(F.spark_partition_id().alias("p"), "k").distinct().collect()
    assert len(got) == 16 and len({r["p"] for r in got}) > 2


def test_learners_by_fold_equal_a_loop(spark):
    x, y = regression(n=90)
    df = frame(spark, [(*p, q, q + 10, 10.0) for p, q in zip(x, y)], "abcde")
    day = lambda i: DAY + dt.timedelta(days=7 * i)
    folds = spark.createDataFrame([(1, day(40), day(59)), (2, day(60), day(200)), (3, day(0), day(10)), (4, day(300), day(400))], "fold_id int, start_date date, end_date date")
    sets = {"price": ["a"], "lags": ["b"], "dynamics": ["a", "b"]}
    run = lambda d: {(r["candidate"], r["fold_id"]): r for r in learn.evaluate_learners(d, ["k"], sets, {"level": "d", "delta": "c"}, "e", learn.candidate_grid(spark, 2), folds).collect()}
    got = run(df)
    assert {f for _, f in got} == {1, 2} and len(got) == 10  # a fold without a known label, or without rows, has no score
    for c in learn.candidate_grid(spark, 2).collect():
        q = x[:, [{"a": 0, "b": 1}[n] for n in sets[c["feature_set"]]]]
        low, high = q[:40].min(0), q[:40].max(0)
        cut = np.clip((q - low) / (high - low), 0, 1)
        t = y if c["target_mode"] == "delta" else (y - y[:40].min()) / (y[:40].max() - y[:40].min())
        model = learn.RuleLearner(q.shape[1], c["width"], c["novelty"], c["most"], c["ridge"], c["radius"])
        p = learn.learned(cut[:60], t[:60], np.arange(60), model)["prediction"].to_numpy()[40:]
        p = p if c["target_mode"] == "delta" else p * (y[:40].max() - y[:40].min()) + y[:40].min()
        one = got[c["candidate"], 1]
        assert one["n"] == 20 and one["mae"] == pytest.approx(np.abs(p - y[40:60]).mean())
        assert one["rmse_ratio"] == pytest.approx(np.sqrt(((p - y[40:60]) ** 2).sum() / (y[40:60] ** 2).sum()))
        assert one["clipped"] == pytest.approx((np.abs((q - low) / (high - low) - cut)[40:60] > 1e-12).mean())
    late = F.col("date") >= day(60)
    turned = run(df.withColumns({n: F.when(late, 99.0).otherwise(F.col(n)) for n in "abcd"}))
    assert all(turned[k] == v for k, v in got.items() if k[1] == 1)
    assert run(df.limit(0)) == {}


def test_hybrid_grid_against_numpy(spark):
    r = np.random.default_rng(8)
    base, c = 100 + r.normal(size=30), 5 * r.normal(size=30)
    actual = base + 0.4 * c
    rows = [(float(a), float(b), None if i == 3 else float(v), i % 2) for i, (a, b, v) in enumerate(zip(actual, base, c))] + [(None, 1.0, 1.0, 0), (1.0, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, f int")
    got = {(x["f"], x["weight"], x["limit"]): x for x in learn.hybrid_grid(df, "a", "b", "c", [0.0, 0.5], [0.02, None], "f").collect()}
    assert len(got) == 8 and got[0, 0.5, None]["n"] == 15 and got[1, 0.0, 0.02]["rmse_ratio"] == pytest.approx(1)
    c[3] = 0
    for f in (0, 1):
        e = (base + np.clip(0.5 * c, -0.02 * base, 0.02 * base) - actual)[f::2]
        assert got[f, 0.5, 0.02]["mae"] == pytest.approx(np.abs(e).mean()) and got[f, 0.5, 0.02]["rmse"] == pytest.approx(np.sqrt((e**2).mean()))


def test_arimax_takes_known_future_values(spark):
    """Values follow a column that jumps about: they can be foretold only where its next value is known."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=140)
    y = 5 + 3 * x + 0.01 * rng.normal(size=140)
    day = dt.date(2020, 1, 6)
    rows = [("a", day + dt.timedelta(weeks=i), float(y[i]), float(x[i]), float(x[i + 1]) if i < 139 else None) for i in range(140)]
    df = spark.createDataFrame(rows, "k string, date date, c double, a double, b double")
    errors = []
    for future in (None, ["b"]):
        got = learn.arimax_walk_forward(df, ["k"], "c", ["a"], future=future).orderBy("date").toPandas()["prediction"].to_numpy()
        errors.append(np.abs(got[110:139] - y[111:140]).mean())
        assert np.isfinite(got).all()
    assert errors[1] < 0.2 < errors[0], errors
    assert got[139] == y[139]
