"""Hand-computed values, missing weeks, causality and partition invariance of the weekly operators."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from weekloom.functions import prep
from weekloom.operators import align, features, score, text

DAY = dt.date(2024, 1, 1)


def series(spark, prices, k=1):
    return spark.createDataFrame([(k, DAY + dt.timedelta(days=7 * i), p) for i, p in enumerate(prices) if p != "gap"], "k int, date date, price double")


def test_grid_and_calendar_target(spark):
    df = series(spark, [1.0, 2.0, "gap", 4.0])
    grid = align.weekly_grid(df, ["k"]).orderBy("date").collect()
    assert [r["price"] for r in grid] == [1.0, 2.0, None, 4.0]
    got = align.calendar_target(df, ["k"], "price", 1).orderBy("date").collect()
    assert [r["target"] for r in got] == [2.0, None, None]
    assert {r["rule"]: r["violations"] for r in align.grid_violations(df.union(df.limit(1)), ["k"]).collect()} == {"null_date": 0, "repeated": 2, "off_calendar": 0}


def test_asof(spark):
    left = series(spark, [1.0] * 3)
    right = spark.createDataFrame([(1, DAY - dt.timedelta(days=2), 5.0), (1, DAY, 6.0), (1, DAY + dt.timedelta(days=10), 7.0), (1, DAY + dt.timedelta(days=4), None)], "k int, date date, v double")
    assert [r["v"] for r in align.asof_backward(left, right, ["k"], ["v"]).orderBy("date").collect()] == [6.0, 6.0, 7.0]
    assert [r["v"] for r in align.asof_nearest(left, right, ["k"], "v", 3).orderBy("date").collect()] == [6.0, 7.0, None]


def test_rolling_rmse_and_conformal(spark):
    df = spark.createDataFrame([(1, DAY + dt.timedelta(days=7 * i), y, h) for i, (y, h) in enumerate([(1.0, 1.0), (2.0, 1.0), (3.0, None), (4.0, 2.0)])], "k int, date date, y double, h double")
    got = [r["rmse"] for r in features.rolling_rmse(df, ["k"], "y", "h", 2).orderBy("date").collect()]
    assert got[0] is None and got[1:] == [pytest.approx(math.sqrt(0.5)), 1.0, 2.0]
    df = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), float(i), 100.0) for i in range(10)], "k int, date date, resid double, yhat double")
    got = features.expanding_conformal(df, ["k"], "resid", "yhat", 5).orderBy("date").collect()
    assert got[4]["lower"] is None and got[5]["lower"] == pytest.approx(100.4) and got[9]["upper"] == pytest.approx(107.2)


def test_winkler_and_events(spark):
    df = spark.createDataFrame([(10.0, 9.0, 11.0), (8.0, 9.0, 11.0), (12.0, 9.0, 11.0)], "actual double, lower double, upper double")
    assert [r[0] for r in df.select(score.winkler(0.2)).collect()] == pytest.approx([2.0, 12.0, 12.0])
    p = spark.createDataFrame([(1, 6.00, 6.00, 6.0), (1, 6.05, 6.00, 6.1), (1, 6.05, 6.05, 6.0), (1, 6.20, 6.05, 6.1)], "k int, actual double, origin double, prediction double")
    got = score.accuracy_report(p, ["k"], 0.01).first()
    assert (got["n"], got["n_event"], got["direction"]) == (4, 2, 1.0)


def test_psi(spark):
    even = spark.createDataFrame([(1, i / 99) for i in range(100)], "k int, v double")
    value = lambda a, b: score.psi(a, b, "v", ["k"]).first()["psi"]
    assert value(even, even) == 0.0
    assert value(even, even.withColumn("v", F.col("v") + 0.4)) > 0.1
    flat = even.withColumn("v", F.lit(1.0))
    assert value(flat, flat) == 0.0


def test_future_does_not_change_the_past(spark):
    prices = [4 + 0.3 * math.sin(i) + 0.01 * i for i in range(80)]
    a = series(spark, prices).withColumn("cost", F.col("price") * 3 + F.dayofyear("date") / 100)
    b = a.withColumn("price", F.when(F.col("date") > DAY + dt.timedelta(days=7 * 60), 99.0).otherwise(F.col("price")))
    for build in (
        lambda d: features.passthrough_panel(d, ["k"], "price", "cost", 20), lambda d: features.pressure_features(d, ["k"], "price", "cost", "price", 1, 20),
        lambda d: features.weekly_features(d, ["k"], ["price"]), lambda d: features.feature_set(d, ["k"], "price"),
        lambda d: features.moving_band(d.withColumn("r", F.col("price") - 4), ["k"], "r", "price", 30), lambda d: features.change_guard(d, ["k"], "price", "cost"),
    ):
        early = lambda d: [tuple(r) for r in build(d).filter(F.col("date") <= DAY + dt.timedelta(days=7 * 60)).orderBy("date").collect()]  # noqa: B023, E731
        assert early(a) == early(b)


def test_bootstrap_is_the_same_with_other_partitions(spark):
    df = series(spark, [float(i % 7) for i in range(40)])
    run = lambda d: sorted(tuple(r) for r in score.block_bootstrap(d, ["k"], "price", "date", 5, 20).collect())
    assert run(df.repartition(1)) == run(df.repartition(16)) and len(run(df)) == 20


def test_prep(spark):
    df = spark.createDataFrame([("R$ 1.234,56", "Óleo Diesel S-10"), ("4.37", "DIESEL S500"), ("x", "gasolina"), (None, None)], "p string, n string")
    got = df.select(prep.parse_price(F.col("p")), prep.canonical_product(F.col("n")), prep.normalize_name(F.col("n"))).collect()
    assert [r[0] for r in got] == [1234.56, 4.37, None, None]
    assert [r[1] for r in got] == ["S10", "S500", None, None]
    assert got[0][2] == "oleo_diesel_s_10"
    m = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (5.0, 1.0, 2.0)], "a double, b double, c double")
    assert [r[0] for r in m.select(prep.row_median(["a", "b", "c"])).collect()] == [2.0, None, 2.0]


def test_folds_blocks_and_pooling(spark):
    df = series(spark, [1.0] * 10)
    got = [r["fold"] for r in align.expanding_folds(df, ["k"], 3, 2, 2).orderBy("date").collect()]
    assert got == ["train"] * 3 + ["validation_1"] * 2 + ["validation_2"] * 2 + ["holdout"] * 3
    blocks = features.contiguous_blocks(series(spark, [1.0, 1.0, 1.0, "gap", 1.0, "gap", 1.0, 1.0, 1.0, 1.0]), ["k"])
    assert sorted(r["count"] for r in blocks.groupBy("block").count().collect()) == [3, 4]
    est = spark.createDataFrame([("g", u, v, 0.1) for u, v in (("a", 0.1), ("b", 0.1), ("c", 0.1), ("d", 0.1))], "g string, u string, kappa double, se double")
    assert all(r["shrunk"] == pytest.approx(0.1) for r in score.pool_reversion(est, ["g"], "u").collect())


def test_stream_equals_batch(spark, tmp_path):
    from weekloom.streaming.weekly import stream_weekly

    rows = [(i, dt.datetime(2024, 1, 1 + i % 20, 5), "ab"[i % 2], float(i)) for i in range(60)]
    e = spark.createDataFrame(rows, "event_id int, ts timestamp, event_type string, value double")
    e.write.parquet(str(tmp_path / "events.parquet"))
    batch = e.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    assert sorted(map(tuple, stream_weekly(spark, str(tmp_path)).collect())) == sorted(map(tuple, batch.collect()))


def test_lexicon_personas(spark):
    news = [
        (1, "Petrobras anuncia reajuste: ALTA do preço do óleo diesel S10"), (2, "Estudo sobre o petróleo"),
        (3, "Dólar \n sobe e\u00a0petróleo cai"), (4, "Greve no transporte de combustível"), (5, "Embargo atinge derivados"), (6, None),
    ]
    df = spark.createDataFrame(news, "k int, body string").withColumn("horizon", F.lit("theirs"))
    got = {(r["k"], r["persona"]): (r["relevance"], r["direction"], r["intensity"], r["horizon"], r["evidence"]) for r in text.lexicon_label(df, "body").collect()}
    first = "diesel s10,diesel,oleo diesel,petrobras,alta do preco,reajuste"
    mixed = (2, "uncertain", 1, "unknown", "petroleo,dolar,dolar sobe,petroleo cai")
    assert len(got) == 18
    assert [got[k, "supply_cost"] for k in range(1, 7)] == [
        (3, "up", 3, "1w", first), (1, "neutral", 0, "unknown", "petroleo"), mixed, (2, "up", 2, "1w", "combustivel,greve"),
        (2, "up", 2, "unknown", "derivados,embargo"), (0, "neutral", 0, "unknown", ""),
    ]
    assert [got[k, "procurement_risk"] for k in range(1, 7)] == [
        (3, "up", 2, "1w", first), (0, "neutral", 0, "unknown", "petroleo"), mixed, (2, "up", 1, "1w", "combustivel,greve"),
        (2, "uncertain", 1, "unknown", "derivados,embargo"), (0, "neutral", 0, "unknown", ""),
    ]
    assert [got[k, "procurement_risk_calibrated"][:3] for k in range(1, 7)] == [
        (3, "up", 2), (0, "neutral", 0), (2, "uncertain", 1), (2, "up", 1), (2, "up", 1), (0, "neutral", 0),
    ]
    with pytest.raises(ValueError):
        text.lexicon_label(df, "body", personas=["nobody"])


def test_importance_of_a_callable_equals_the_linear_form(spark):
    rows = [(i % 3, i, float(i * 7 % 11), float(i * 5 % 13), float(i % 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "k int, i int, a double, b double, y double")
    linear = score.permutation_importance(df, ["k"], {"a": 0.5, "b": -0.25}, "y", "i")
    called = score.permutation_importance(df, ["k"], ["a", "b"], "y", "i", scorer=lambda x: 0.5 * x["a"] - 0.25 * x["b"])
    values = lambda d: {(r["k"], r["feature"]): pytest.approx(r["importance"]) for r in d.collect()}
    assert {k: v.expected for k, v in values(called).items()} == values(linear)
