"""Alignment on the weekly calendar, joins without a look into the future, folds.

Every operator takes ``keys`` (series keys) and a date column; windows of one chain share partitioning by ``keys``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan

#: Folds are sent to every task; this bounds their table.
MOST_FOLDS = 10_000


def by_date(keys: Sequence[str], date: str = "date"):
    return W.partitionBy(*keys).orderBy(date)


def weekly_grid(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Every week from a key's first to its last, with NULLs where it has no row."""
    ends = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    grid = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 7 days"))).alias(date))
    return grid.join(df, [*keys, date], "left")


def grid_violations(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """(rule, violations): null dates, repeated dates, dates off the key's seven-day calendar."""
    first = F.min(date).over(W.partitionBy(*keys))
    again = F.count(F.lit(1)).over(W.partitionBy(*keys, date)) > 1
    x = df.select(F.col(date).isNull().alias("null_date"), again.alias("repeated"), (F.datediff(date, first) % 7 != 0).alias("off_calendar"))
    one = x.agg(*[F.count(F.when(F.col(c), 1)).alias(c) for c in x.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in x.columns])).alias("v")).select("v.*")


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], date: str = "date") -> DataFrame:
    """The last known values at or before each left date: one union, one sort, no range join. Without keys, a prefix scan."""
    if not keys:
        return scan.asof_backward(left, right, keys, columns, date)
    both = left.withColumn("_left", F.lit(1)).unionByName(right.select(*keys, date, *columns).withColumn("_left", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(date, "_left").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).filter("_left = 1").drop("_left")


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str, tolerance: int, date: str = "date") -> DataFrame:
    """The value nearest in days within the tolerance (inclusive); at equal distance the earlier one. Without keys, prefix scans."""
    if not keys:
        return scan.asof_nearest(left, right, keys, column, tolerance, date)
    both = left.withColumn("_left", F.lit(1)).unionByName(right.select(*keys, date, column).withColumn("_left", F.lit(0)), allowMissingColumns=True)
    own = F.when((F.col("_left") == 0) & F.col(column).isNotNull(), F.struct(F.col(date).alias("d"), F.col(column).alias("v")))
    back = F.last(own, ignorenulls=True).over(W.partitionBy(*keys).orderBy(date, "_left").rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(own, ignorenulls=True).over(W.partitionBy(*keys).orderBy(date, F.desc("_left")).rowsBetween(0, W.unboundedFollowing))
    x = both.withColumns({"_b": back, "_f": ahead}).filter("_left = 1")
    db, df_ = F.datediff(date, "_b.d"), F.datediff("_f.d", date)
    near = F.when(db.isNotNull() & (df_.isNull() | (db <= df_)), F.struct(db.alias("g"), F.col("_b.v").alias("v"))).otherwise(F.struct(df_.alias("g"), F.col("_f.v").alias("v")))
    return x.withColumn("_n", near).withColumn(column, F.when(F.col("_n.g") <= tolerance, F.col("_n.v"))).drop("_left", "_b", "_f", "_n")


def cardinality_violations(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """(side, repeated keys) for a join that must be one to one."""
    twice = lambda d, s: d.groupBy(*on).count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated")).select(F.lit(s).alias("side"), "repeated")
    return twice(a, "left").unionByName(twice(b, "right"))


def join_one_to_one(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    if cardinality_violations(a, b, on).filter("repeated > 0").limit(1).count():
        raise ValueError(f"{list(on)} isn't unique on both sides")
    return a.join(b, list(on), how)


def calendar_target(df: DataFrame, keys: Sequence[str], value: str, horizon: int, date: str = "date") -> DataFrame:
    """target and target_date exactly ``horizon`` weeks later on the calendar, NULL where that week has no row."""
    later = df.select(*keys, F.date_sub(date, 7 * horizon).alias(date), F.col(value).alias("target"))
    return df.join(later, [*keys, date], "left").withColumn("target_date", F.date_add(date, 7 * horizon))


def lagged_dataset(df: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int], horizon: int, date: str = "date") -> DataFrame:
    """Row lags, the target ``horizon`` rows ahead and its date; complete rows only."""
    w = by_date(keys, date)
    out = df.withColumns({**{f"lag_{k}": F.lag(value, k).over(w) for k in lags}, "target": F.lead(value, horizon).over(w), "target_date": F.lead(date, horizon).over(w)})
    return out.dropna(subset=[*(f"lag_{k}" for k in lags), "target", value])


def articles_in_lookback(articles: DataFrame, origins: DataFrame, days: int, available: str = "available", sha: str = "sha", record: str = "record_id", origin: str = "origin") -> DataFrame:
    """(origin, record) of articles in (origin - days, origin], one per content and origin: the first by time and id.

    An article is exploded to the weeks it can reach and joined by equality, so no range join is needed.
    """
    first_monday = F.date_trunc("week", available).cast("date")
    weeks = F.explode(F.sequence(first_monday, F.date_add(F.to_date(available), days + 6), F.expr("interval 7 days")))
    o = origins.select(F.col(origin), F.date_trunc("week", origin).cast("date").alias("_w")).distinct()
    hit = articles.withColumn("_w", weeks).join(o, "_w").filter((F.col(available) <= F.col(origin)) & (F.col(available) > F.date_sub(origin, days)))
    w = W.partitionBy(origin, sha).orderBy(available, record)
    return hit.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_w")


def require_coverage(base: DataFrame, feat: DataFrame, on: Sequence[str]) -> DataFrame:
    """Base rows without a feature row; an empty result means full coverage."""
    return base.join(feat, list(on), "left_anti")


def augment(base: DataFrame, feat: DataFrame, on: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Base rows with the features; values that aren't finite become NULL."""
    clean = {n: F.when(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), F.col(n)) for n in names}
    return base.join(feat.select(*on, *names).withColumns(clean), list(on), "left")


def expanding_folds(df: DataFrame, keys: Sequence[str], holdout: int, size: int, n: int, date: str = "date") -> DataFrame:
    """fold: 'train', 'validation_1' to 'validation_n', 'holdout', counted back from each key's end."""
    back = F.count(F.lit(1)).over(W.partitionBy(*keys)) - F.row_number().over(by_date(keys, date))
    k = n - F.floor((back - holdout) / size)
    fold = F.when(back < holdout, "holdout").when(k >= 1, F.concat(F.lit("validation_"), k.cast("string"))).otherwise("train")
    return df.withColumn("fold", fold)


def pinned_folds(df: DataFrame, start: str, end: str, size: int, n: int, date: str = "date") -> DataFrame:
    """Folds fixed by the holdout's first and last date; later rows are prospective, earlier ones development."""
    weeks = F.floor(F.datediff(F.lit(start).cast("date"), date) / 7.0 + 6 / 7)
    k = n - F.floor((weeks - 1) / size)
    d = F.col(date)
    fold = F.when(d > F.lit(end).cast("date"), "prospective").when(d >= F.lit(start).cast("date"), "holdout").when(k >= 1, F.concat(F.lit("validation_"), k.cast("string"))).otherwise("development")
    return df.withColumn("fold", fold)


def holdout_length(df: DataFrame, keys: Sequence[str], weeks: int) -> DataFrame:
    """(keys, n, complete): the holdout's rows of each series, and whether they are as many as pinned."""
    return df.groupBy(*keys).agg(F.count(F.when(F.col("fold") == "holdout", 1)).alias("n")).withColumn("complete", F.col("n") == weeks)


def fold_contiguity(df: DataFrame, keys: Sequence[str], date: str = "date", fold: str = "fold_id") -> DataFrame:
    """(keys, fold, n, contiguous): whether the rows of a fold follow each other without a row of another fold between them."""
    x = df.withColumn("_i", F.row_number().over(by_date(keys, date)))
    return x.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("n"), (F.max("_i") - F.min("_i") + 1 == F.count(F.lit(1))).alias("contiguous"))


def exact_week_pairs(df: DataFrame, horizon: int, origin: str, target: str) -> DataFrame:
    return df.filter(F.datediff(target, origin) == 7 * horizon)


def remap_fold(df: DataFrame, folds: DataFrame, date: str = "target_date") -> DataFrame:
    """Relabels rows by the fold (fold_id, start_date, end_date) their target falls in; more than ``MOST_FOLDS`` folds are an error."""
    f = folds.select("fold_id", "start_date", "end_date")
    if f.limit(MOST_FOLDS + 1).count() > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    return df.drop("fold_id").join(F.broadcast(f), F.col(date).between(F.col("start_date"), F.col("end_date"))).drop("start_date", "end_date")


def known_target_end(df: DataFrame, keys: Sequence[str], date: str = "date", target_date: str = "target_date") -> DataFrame:
    """known: how many targets of the key are observed by each row's date."""
    seen = df.select(*keys, F.col(target_date).alias("_d"), F.lit(1).alias("_n"), F.lit(0).alias("_o")).filter("_d is not null")
    asked = df.select(*keys, F.col(date).alias("_d"), F.lit(0).alias("_n"), F.lit(1).alias("_o"))
    w = W.partitionBy(*keys).orderBy("_d").rangeBetween(W.unboundedPreceding, 0)
    got = seen.unionByName(asked).withColumn("known", F.sum("_n").over(w)).filter("_o = 1").select(*keys, F.col("_d").alias(date), "known").distinct()
    return df.join(got, [*keys, date])


def state_panels(state: DataFrame, national: DataFrame, producer: DataFrame, region: str, date: str = "date", tolerance: int = 3) -> DataFrame:
    """Each state's rows with the national price of the date and the nearest producer price of its region."""
    near = asof_nearest(state.select(region, date).distinct(), producer, [region], "producer", tolerance, date)
    return state.join(national, date, "left").join(near, [region, date], "left")


def union_dedupe(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both histories, one row per key: the old one first."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_o"))).filter("_n = 1").drop("_o", "_n")


def gated(value: Column, count_of: Column, at_least: int) -> Column:
    return F.when(count_of >= at_least, value)
