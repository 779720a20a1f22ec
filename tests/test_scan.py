"""Prefix scans against the windows that they stand for."""
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.operators import align, features, ledger, scan
from weekloom.sources import scratch

DAY = date(2020, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = [(k, DAY + timedelta(t * 7 if rng.random() < 0.95 else t * 7 + 1), rng.choice([None, 1.0, 2.5, 100.0]), rng.random() + 1) for k in (None, 1, 2) for t in range(120 if k == 1 else 9)]
    return spark.createDataFrame(rows, "k int, date date, v double, p double").dropDuplicates(["k", "date"]).repartition(3)


def rows_of(df):
    digits = lambda x: round(x, 8) if isinstance(x, float) else x
    return sorted((tuple((n, digits(r[n])) for n in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 5, 60])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("backward", [True, False])
def test_running_equals_windows(series, parts, inclusive, backward):
    r = scan.Ranges(series, ["k"], ["date"], parts)
    own = r.running(r.rows, {"s": F.col("v"), "n": F.when(F.col("v").isNotNull(), 1)}, {"l": F.col("v")}, inclusive, backward).drop("_part")
    w = W.partitionBy("k").orderBy(F.desc("date") if backward else F.asc("date")).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    assert rows_of(own) == rows_of(series.withColumns({"s": F.sum("v").over(w), "n": F.sum(F.when(F.col("v").isNotNull(), 1)).over(w), "l": F.last("v", ignorenulls=True).over(w)}))


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_bounded_frames_equal_windows(series, parts):
    def frames(df, keys):
        w = W.partitionBy(*keys).orderBy("date")
        return df.withColumns({"a": F.avg("v").over(w.rowsBetween(-7, -1)), "b": F.lead("p", 3).over(w), "c": F.count("v").over(w.rowsBetween(-2, 5)), "d": F.lag("p", 7).over(w)})

    own = scan.in_ranges(series, ["k"], "date", frames, 7, 5, parts)
    assert rows_of(own) == rows_of(frames(series, ["k"]))


def one_key(df):
    return df.withColumn("g", F.lit(1))


def test_keyless_features_equal_one_key(series):
    s = series.filter("k = 1").drop("k")
    g = one_key(s)
    for f in (
        lambda x, k: features.weekly_features(x, k, ["p"]), lambda x, k: features.price_jump_proxy(x, k, "p"), lambda x, k: features.feature_set(x, k, "p"),
        lambda x, k: features.rolling_rmse(x, k, "p", "v"), lambda x, k: features.contiguous_blocks(x, k), lambda x, k: features.episodes(x, k, F.col("p") > 1.5, 1),
        lambda x, k: features.expanding_coint_residual(x.filter("v is not null"), k, "p", "v", 10),
    ):
        assert rows_of(f(s, [])) == rows_of(f(g, ["g"]).drop("g"))


def test_keyless_asof_equals_one_key(series, spark):
    left = series.filter("k = 1").select("date", "p")
    right = series.filter("k = 1").select(F.date_add("date", 2).alias("date"), "v").union(series.filter("k = 1 and p > 1.5").select("date", F.lit(7.0)))
    assert rows_of(align.asof_backward(left, right, [], ["v"])) == rows_of(align.asof_backward(one_key(left), one_key(right), ["g"], ["v"]).drop("g"))
    assert rows_of(align.asof_nearest(left, right, [], "v", 3)) == rows_of(align.asof_nearest(one_key(left), one_key(right), ["g"], "v", 3).drop("g"))
    assert align.asof_backward(left.limit(0), right.limit(0), [], ["v"]).collect() == []


def test_no_range_holds_many_rows_of_a_long_series(spark):
    n, parts = 2_000_000, 100
    left = spark.range(n).select(F.expr("timestamp_seconds(id)").alias("date"), "id")
    right = spark.range(0, n, 1000).select(F.expr("timestamp_seconds(id)").alias("date"), F.col("id").alias("v"))
    both = left.withColumn("_left", F.lit(1)).unionByName(right.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    r = scan.Ranges(both, [], ["date", "_left"], parts)
    assert r.rows.groupBy("_part").count().agg(F.max("count")).first()[0] <= 0.02 * n
    out = scan.asof_backward(left, right, [], ["v"], parts=parts)
    assert out.agg(F.count("v"), F.sum((F.col("v") == F.col("id") - F.col("id") % 1000).cast("int"))).first()[:] == (n, n)


def test_a_single_ledger_of_many_ranges(spark):
    e = spark.range(500).selectExpr("id", "concat('p', id) AS payload", "id + 1 AS sequence", "cast(null as string) AS previous_hash")
    e = e.withColumn("record_hash", F.when(F.col("id") % 50 != 7, ledger.record_hash(["payload"])))
    e = e.withColumn("previous_hash", F.lag("record_hash").over(W.partitionBy(F.lit(1)).orderBy("id"))).withColumn("sequence", F.when(F.col("id") != 400, F.col("sequence")))
    e = e.withColumn("previous_hash", F.when(F.col("id") % 100 == 99, "x").otherwise(F.col("previous_hash")))
    assert ledger.verify_ledger(e, [], "id", ["payload"]).collect()[0][:] == (500, 10, 5, 1)
    assert ledger.verify_ledger(e.withColumn("g", F.lit(1)), ["g"], "id", ["payload"]).collect()[0][1:] == (500, 10, 5, 1)


def test_cleanup_takes_away_what_was_staged(spark):
    path = scratch.new_folder(spark, "x")
    spark.range(3).write.parquet(path)
    assert scratch.cleanup(spark) >= 1 and scratch.cleanup(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
