"""Prefix scans: windows over series that are too long for one task, and over tables without any key.

A window without keys, or with one huge key, is one task. Here rows are dealt to ranges of (keys, order) and written once,
so a range is a bounded share of the rows however long a series is. Each range is scanned by itself; a small table, one
row a range and key, carries over what the ranges before it hold: sums, last known values, or the rows next to its edges
(``with_halo``), for frames of a bounded number of rows. All of it is windows and equi-joins of Spark.

Rows that share keys and order must be told apart by a further column of ``order`` where their order matters, and where they
are so many that one range should not hold them all. Nulls come first, as in Spark's windows.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.sources.scratch import staged

PART, HALO = "_part", "_halo"


def _same(names: Sequence[str]) -> Column:
    """Equality of columns with their counterparts named ``_x_``; null keys are a key of their own."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_x_{c}")) for c in names])


def _aside(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_x_{c}" for c in names})


class Ranges:
    """The rows of ``df`` in ranges of (keys, order): ``rows`` has them with the number of their range in ``_part``."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None):
        self.keys, self.order = list(keys), list(order)
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = staged(df.repartitionByRange(parts, *self.keys, *self.order).withColumn(PART, F.spark_partition_id()), "ranges")
        self.parts = parts

    def _own(self, df: DataFrame) -> DataFrame:
        """A task a range: the windows below then need no further exchange."""
        return df.repartitionById(self.parts, PART)

    def _window(self, backward: bool = False):
        return W.partitionBy(PART, *self.keys).orderBy(*[F.desc(c) if backward else F.asc(c) for c in self.order])

    def running(self, df: DataFrame, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, inclusive: bool = True, backward: bool = False) -> DataFrame:
        """``df`` with running sums and last known values of each row's key, up to the row (with it if ``inclusive``).

        ``df``: ``rows``, or what column expressions have made of them. ``backward`` runs from the end: sums of what follows
        and next known values. As in SQL, a sum of no values is null.
        """
        sums, last = sums or {}, last or {}
        frame = self._window(backward).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        own = {**{n: F.sum(c).over(frame) for n, c in sums.items()}, **{n: F.last(c, ignorenulls=True).over(frame) for n, c in last.items()}}
        pick, place = (F.min_by if backward else F.max_by), F.struct(*self.order)
        whole = [F.sum(c).alias(n) for n, c in sums.items()] + [pick(F.struct(c.alias("v")), F.when(c.isNotNull(), place)).alias(n) for n, c in last.items()]
        totals = df.groupBy(PART, *self.keys).agg(*whole)
        before = W.partitionBy(*self.keys).orderBy(F.desc(PART) if backward else F.asc(PART)).rowsBetween(W.unboundedPreceding, -1)  # one row a range
        carried = totals.select(
            F.col(PART).alias(f"_x_{PART}"), *[F.col(k).alias(f"_x_{k}") for k in self.keys],
            *[F.sum(n).over(before).alias(f"_c_{n}") for n in sums], *[F.last(n, ignorenulls=True).over(before)["v"].alias(f"_c_{n}") for n in last],
        )
        both = self._own(df).withColumns(own).join(carried, _same([PART, *self.keys]), "left")
        put = {n: F.coalesce(F.col(n) + F.col(f"_c_{n}"), n, f"_c_{n}") for n in sums} | {n: F.coalesce(n, f"_c_{n}") for n in last}
        return both.withColumns(put).drop(*[f"_x_{k}" for k in (PART, *self.keys)], *[f"_c_{n}" for n in (*sums, *last)])

    def _edge(self, df: DataFrame, rows: int, backward: bool) -> DataFrame:
        """The ``rows`` rows of each key next to a range's edge, once for each range on the other side that needs them."""
        toward = F.desc(PART) if backward else F.asc(PART)
        in_key = W.partitionBy(*self.keys).orderBy(toward)  # one row a range and key
        sizes = df.groupBy(PART, *self.keys).agg(F.count(F.lit(1)).alias("_n"))
        sizes = sizes.withColumns({"_nth": F.row_number().over(in_key), "_start": F.sum("_n").over(in_key) - F.col("_n")})
        # ranges that begin less than ``rows`` rows after this one begins; the range before this one reaches as many
        near = F.count(F.lit(1)).over(W.partitionBy(*self.keys).orderBy("_start").rangeBetween(0, rows - 1))
        sizes = staged(sizes.withColumn("_near", near).withColumn("_reach", F.coalesce(F.lead("_near").over(in_key), F.lit(0))), "range-sizes")
        tail = df.withColumn("_r", F.row_number().over(self._window(not backward))).filter(F.col("_r") <= rows)
        tail = tail.join(_aside(sizes.select(PART, *self.keys, "_nth", "_reach", (F.col("_start") + F.col("_n")).alias("_end")), [PART, *self.keys]), _same([PART, *self.keys]))
        tail = tail.drop(*[f"_x_{k}" for k in (PART, *self.keys)], PART).filter("_reach > 0").withColumn("_to", F.explode(F.sequence(F.lit(1), F.col("_reach"))))
        goal = sizes.select(PART, *[F.col(k).alias(f"_x_{k}") for k in self.keys], F.col("_nth").alias("_x__goal"), F.col("_start").alias("_goal_start"))
        tail = tail.withColumn("_goal", F.col("_nth") + F.col("_to"))
        out = tail.join(goal, _same([*self.keys, "_goal"])).filter(F.col("_r") - 1 + F.col("_goal_start") - F.col("_end") < rows)
        return out.select(*df.columns).withColumn(HALO, F.lit(True))

    def with_halo(self, df: DataFrame, back: int = 0, ahead: int = 0) -> DataFrame:
        """``df`` and, in every range, the ``back`` rows before it and the ``ahead`` rows after it of the same key.

        These rows are marked in ``_halo``. Frames of so many rows, partitioned by [``_part``, *keys], are then whole for all
        rows that aren't marked.
        """
        out = df.withColumn(HALO, F.lit(False))
        if back:
            out = out.unionByName(self._edge(df, back, False))
        if ahead:
            out = out.unionByName(self._edge(df, ahead, True))
        return self._own(out)


def in_ranges(df: DataFrame, keys: Sequence[str], date: str, fn: Callable[[DataFrame, list[str]], DataFrame], back: int = 0, ahead: int = 0, parts: int | None = None) -> DataFrame:
    """``fn(df, keys)`` for window features of at most ``back`` rows before and ``ahead`` rows after each row, range by range.

    ``fn`` keeps all columns that it is given, and makes one row of each.
    """
    ranges = Ranges(df, keys, [date], parts)
    out = fn(ranges.with_halo(ranges.rows, back, ahead), [PART, *keys])
    return out.filter(~F.col(HALO)).drop(PART, HALO)


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], date: str = "date", parts: int | None = None) -> DataFrame:
    """As ``align.asof_backward``, by a prefix scan: no task holds a series, or all rows where there are no keys."""
    both = left.withColumn("_left", F.lit(1)).unionByName(right.select(*keys, date, *columns).withColumn("_left", F.lit(0)), allowMissingColumns=True)
    ranges = Ranges(both, keys, [date, "_left"], parts)
    out = ranges.running(ranges.rows, last={f"_l_{c}": F.col(c) for c in columns})
    return out.filter("_left = 1").withColumns({c: F.col(f"_l_{c}") for c in columns}).drop(PART, "_left", *[f"_l_{c}" for c in columns])


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str, tolerance: int, date: str = "date", parts: int | None = None) -> DataFrame:
    """As ``align.asof_nearest``, by one scan in either direction over the same ranges."""
    both = left.withColumn("_left", F.lit(1)).unionByName(right.select(*keys, date, column).withColumn("_left", F.lit(0)), allowMissingColumns=True)
    ranges = Ranges(both, keys, [date, "_left"], parts)
    own = F.when((F.col("_left") == 0) & F.col(column).isNotNull(), F.struct(F.col(date).alias("d"), F.col(column).alias("v")))
    x = ranges.running(ranges.running(ranges.rows, last={"_b": own}), last={"_f": own}, backward=True).filter("_left = 1")
    db, da = F.datediff(date, "_b.d"), F.datediff("_f.d", date)
    near = F.when(db.isNotNull() & (da.isNull() | (db <= da)), F.struct(db.alias("g"), F.col("_b.v").alias("v"))).otherwise(F.struct(da.alias("g"), F.col("_f.v").alias("v")))
    return x.withColumn("_n", near).withColumn(column, F.when(F.col("_n.g") <= tolerance, F.col("_n.v"))).drop(PART, "_left", "_b", "_f", "_n")


def _islands(ranges: Ranges, df: DataFrame, date: str, new: Callable[[Column], Column], out: str) -> DataFrame:
    """``df`` with the number of rows so far for which ``new`` holds of the days since the row before (null at first)."""
    x = ranges.running(df, last={"_d": F.col(date)}, inclusive=False)
    x = x.withColumn("_new", F.coalesce(new(F.datediff(date, "_d")), F.lit(True)).cast("int"))
    return ranges.running(x, sums={out: F.col("_new")}).drop("_d", "_new")


def contiguous_blocks(df: DataFrame, keys: Sequence[str], step: int = 7, at_least: int = 3, date: str = "date", parts: int | None = None) -> DataFrame:
    """As ``features.contiguous_blocks``, by two scans; the sizes of blocks come from an aggregate, which is combined before its shuffle."""
    ranges = Ranges(df, keys, [date], parts)
    x = _islands(ranges, ranges.rows, date, lambda days: days != step, "block").drop(PART)
    sizes = x.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    names = [*keys, "block"]
    return x.join(_aside(sizes, names), _same(names)).drop("_n", *[f"_x_{k}" for k in names])


def episodes(df: DataFrame, keys: Sequence[str], mask: Column, min_gap: int = 8, date: str = "date", parts: int | None = None) -> DataFrame:
    """As ``features.episodes``, by two scans."""
    ranges = Ranges(df.filter(mask), keys, [date], parts)
    return _islands(ranges, ranges.rows, date, lambda days: days > 7 * min_gap, "episode").drop(PART)


def expanding_moments(ranges: Ranges, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with {name}_n, {name}_mean and {name}_sd of all earlier values of each column.

    Sums are taken of the values less the first one of the whole table's ranges, so that large levels lose no digits.
    """
    shift = {n: F.col(f"_s_{n}") for n in columns}
    first = df.agg(*[F.min_by(c, F.when(c.isNotNull(), F.struct(*ranges.order))).alias(f"_s_{n}") for n, c in columns.items()])
    x = df.crossJoin(F.broadcast(first))  # one row
    sums = {}
    for n, c in columns.items():
        sums |= {f"{n}_n": F.when(c.isNotNull(), 1), f"_1_{n}": c - shift[n], f"_2_{n}": (c - shift[n]) * (c - shift[n])}
    x = ranges.running(x, sums=sums, inclusive=False)
    put = {}
    for n in columns:
        k, one, two = F.coalesce(f"{n}_n", F.lit(0)), F.col(f"_1_{n}"), F.col(f"_2_{n}")
        spread = F.greatest(two - one * one / k, F.lit(0.0))
        put |= {f"{n}_n": k, f"{n}_mean": F.when(k > 0, shift[n] + one / k), f"{n}_sd": F.when(k > 1, F.sqrt(spread / (k - 1)))}
    return x.withColumns(put).drop(*[f"{p}{n}" for n in columns for p in ("_s_", "_1_", "_2_")])


def expanding_coint_residual(df: DataFrame, keys: Sequence[str], y: str, x: str, warmup: int, date: str = "date", out: str = "coint", parts: int | None = None) -> DataFrame:
    """As ``features.expanding_coint_residual``, by two scans over the same ranges."""
    ly, lx = F.log(y), F.log(x)
    ranges = Ranges(df.withColumns({"_y": F.when(lx.isNotNull(), ly), "_x": F.when(ly.isNotNull(), lx)}), keys, [date], parts)
    s = {"_n": F.when(F.col("_x").isNotNull(), 1), "_sx": F.col("_x"), "_sy": F.col("_y"), "_sxx": F.col("_x") * F.col("_x"), "_sxy": F.col("_x") * F.col("_y")}
    d = ranges.running(ranges.rows, sums=s, inclusive=False)
    n, sx, sy = F.col("_n"), F.col("_sx"), F.col("_sy")
    slope = (n * F.col("_sxy") - sx * sy) / F.nullif(n * F.col("_sxx") - sx * sx, F.lit(0.0))
    r = F.when(n >= warmup, F.col("_y") - sy / n - slope * (F.col("_x") - sx / n))
    d = expanding_moments(ranges, d.withColumn("_r", r), {"_r": F.col("_r")})
    sd = F.when(F.col("_r_n") >= 2, F.col("_r_sd"))
    return d.withColumn(out, F.col("_r") / F.nullif(sd, F.lit(0.0))).drop(PART, "_y", "_x", *s, "_r", "_r_n", "_r_mean", "_r_sd")
