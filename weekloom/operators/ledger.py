"""Hash-chained ledgers of forecasts: verify, issue, settle, review."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan


def record_hash(content: Sequence[str]) -> Column:
    """sha256 of the fields joined by '|'; NULLs are empty. A true chain has previous_hash among its content."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)


def verify_ledger(df: DataFrame, ledger: Sequence[str], order: str, content: Sequence[str], sequence: str = "sequence") -> DataFrame:
    """(ledger, records, bad_hash, bad_link, bad_sequence): rows whose stored hash, link to the row before, or number is wrong."""
    if ledger:
        w = W.partitionBy(*ledger).orderBy(order)
        df = df.withColumns({"_before": F.lag("record_hash", 1).over(w), "_nth": F.row_number().over(w)})
    else:  # a single chain of any length, range by range
        ranges = scan.Ranges(df, [], [order])
        df = ranges.running(ranges.rows, {"_nth": F.lit(1)}).drop("_before")
        df = ranges.running(df, last={"_row": F.struct("record_hash")}, inclusive=False).withColumn("_before", F.col("_row.record_hash"))
    before = F.coalesce("_before", F.lit(""))
    x = df.select(*ledger, (~record_hash(content).eqNullSafe(F.col("record_hash"))).alias("h"), (~before.eqNullSafe(F.coalesce("previous_hash", F.lit("")))).alias("l"), (F.col("_nth") != F.coalesce(sequence, F.lit(-1))).alias("s"))
    return x.groupBy(*ledger).agg(F.count(F.lit(1)).alias("records"), *[F.count(F.when(F.col(c), 1)).alias(n) for c, n in (("h", "bad_hash"), ("l", "bad_link"), ("s", "bad_sequence"))])


def latest_issued(ledger: DataFrame, on: Sequence[str], sequence: str = "sequence") -> DataFrame:
    """The last issued or revised forecast per target: one aggregation, no window."""
    own = [c for c in ledger.columns if c not in on]
    x = ledger.filter(F.col("event").isin("forecast_issued", "forecast_revision"))
    return x.groupBy(*on).agg(F.max_by(F.struct(*own), sequence).alias("x")).select(*on, "x.*")


def issue_forecasts(ledger: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """New events (on, artifact, event): issued where the target is unknown, a revision where the artifact differs, nothing where it is equal."""
    old = latest_issued(ledger, on).select(*on, F.col("artifact").alias("_a"), F.lit(1).alias("_known"))
    x = new.join(old, list(on), "left")
    event = F.when(F.col("_known").isNull(), "forecast_issued").when(~F.col("artifact").eqNullSafe(F.col("_a")), "forecast_revision")
    return x.withColumn("event", event).filter(F.col("event").isNotNull()).drop("_a", "_known")


def settle(ledger: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Realised events: the latest pending forecast of each observed week, once; weeks settled before are left out."""
    done = ledger.filter("event = 'forecast_realized'").select(*on).distinct()
    x = latest_issued(ledger, on).join(done, list(on), "left_anti").join(observed.select(*on, "actual"), list(on))
    inside = F.col("actual").between(F.col("lower"), F.col("upper"))
    return x.withColumns({"event": F.lit("forecast_realized"), "abs_error": F.abs(F.col("prediction") - F.col("actual")), "base_error": F.abs(F.col("origin") - F.col("actual")), "inside": inside})


def review_ledger(latest: DataFrame, settled: DataFrame, keys: Sequence[str], target: str, today: Column, nominal: float = 0.8, tolerance: float = 0.1, late_weeks: int = 2, at_least: int = 20, goal: int = 26) -> DataFrame:
    """Per ledger: issued, settled, pending, longest wait in weeks, coverage, errors, the alerts and their highest level.

    Alerts are an array of (level, code), the gravest first: critical late_settlement (a forecast waits longer than
    ``late_weeks``) and worse_than_naive, warning coverage (farther than ``tolerance`` from nominal, on either side), info goal_reached. Without
    any the level is ok.
    """
    s = settled.select(*keys, target, "abs_error", "base_error", F.col("inside").cast("double").alias("inside"))
    x = latest.select(*keys, target).join(s, [*keys, target], "left")
    wait = F.when(F.col("abs_error").isNull(), F.greatest(F.floor(F.datediff(today, F.col(target)) / 7), F.lit(0)))
    one = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("issued"), F.count("abs_error").alias("settled"), F.count(F.when(F.col("abs_error").isNull(), 1)).alias("pending"), F.max(wait).alias("weeks_pending"), F.avg("inside").alias("coverage"), F.avg("abs_error").alias("mae"), F.avg("base_error").alias("base_mae"))
    enough = F.col("settled") >= at_least
    rules = [
        ("critical", "late_settlement", F.col("weeks_pending") > late_weeks), ("critical", "worse_than_naive", enough & (F.col("mae") > F.col("base_mae"))),
        ("warning", "coverage", enough & (F.abs(F.col("coverage") - nominal) > tolerance)), ("info", "goal_reached", F.col("settled") >= goal),
    ]
    alerts = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, when in rules]))
    return one.withColumn("alerts", alerts).withColumn("level", F.coalesce(F.get("alerts", 0)["level"], F.lit("ok")))
