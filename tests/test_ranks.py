"""Quantiles of frames against sorting every frame."""
import time

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.operators import features
from weekloom.operators.ranks import frame_quantiles, order_statistics, with_quantiles


def brute(values, start, end, shares, at_least):
    out = np.full((len(values), len(shares)), np.nan)
    for i in range(len(values)):
        own = values[0 if start is None else max(0, i + start) : max(0, i + end + 1)]
        own = own[np.isfinite(own)]
        if len(own) >= max(1, at_least):
            out[i] = np.quantile(own, shares)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 65, 300])
@pytest.mark.parametrize("frame", [(None, -1, 20), (None, 0, 1), (-13, -1, 5), (-5, 0, 0), (-3, 3, 2), (-400, 400, 1)])
def test_frames(n, frame):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 20, n) / 4.0  # many ties
    values[rng.random(n) < 0.2] = np.nan
    shares = [0.0, 0.1, 0.5, 0.995, 1.0]
    np.testing.assert_allclose(frame_quantiles(values, *frame[:2], shares, frame[2]), brute(values, *frame[:2], shares, frame[2]), rtol=1e-12)


def test_order_statistics_of_any_frames():
    rng = np.random.default_rng(1)
    values = rng.standard_normal(500)
    a = rng.integers(0, 499, 2000)
    b = a + 1 + (rng.random(2000) * (500 - a)).astype(int).clip(0, 499 - a)
    k = (rng.random(2000) * (b - a)).astype(int)
    assert order_statistics(values, a, b, k).tolist() == [np.sort(values[i:j])[m] for i, j, m in zip(a, b, k)]


def test_time_follows_the_length():
    def seconds(n):
        values = np.random.default_rng(0).standard_normal(n)
        best = np.inf
        for _ in range(3):
            began = time.process_time()
            found = frame_quantiles(values, None, -1, [0.1, 0.9], 20)
            best = min(best, time.process_time() - began)
        assert found[-1, 0] == pytest.approx(np.quantile(values[:-1], 0.1), abs=1e-12)
        return best

    assert seconds(200_000) < 8 * seconds(50_000) + 0.5  # a square law would be 16 times


def test_columns_equal_percentile_over_windows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(t), None if rng.random() < 0.1 else float(rng.integers(0, 9)), f"x{k}", [1]) for k in (None, 1, 2) for t in rng.permutation(60)]
    df = spark.createDataFrame(rows, "k int, date int, v double, _text string, extra array<int>")
    w = W.partitionBy("k").orderBy("date")
    for start, end, need in ((None, -1, 10), (-9, -1, 4), (-5, 0, 1)):
        frame = w.rowsBetween(W.unboundedPreceding if start is None else start, end)
        q = F.when(F.count("v").over(frame) >= need, F.percentile("v", F.array(F.lit(0.1), F.lit(0.75))).over(frame))
        own, theirs = with_quantiles(df, ["k"], "v", [0.1, 0.75], start, end, need), df.withColumn("_q", q)
        key = lambda r: (r["k"] or 0, r["date"])
        assert sorted(own.collect(), key=key) == sorted(theirs.collect(), key=key)
    assert with_quantiles(df.limit(0), ["k"], "v", [0.5], -3, 0).collect() == []


def test_keyless_bands(spark):
    df = spark.range(400).selectExpr("cast(id as int) AS date", "sin(id * id) AS resid", "1.0D AS yhat")
    one = features.moving_band(df.withColumn("g", F.lit(1)), ["g"], "resid", "yhat", 50).drop("g")
    assert sorted(features.moving_band(df, [], "resid", "yhat", 50).collect()) == sorted(one.collect())
    one = features.change_guard(df.withColumn("g", F.lit(1)), ["g"], "resid", "yhat", 50).drop("g")
    assert sorted(features.change_guard(df, [], "resid", "yhat", 50).collect()) == sorted(one.collect())
