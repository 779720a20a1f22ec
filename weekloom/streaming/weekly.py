"""Weekly aggregates of an event stream, with a watermark for late rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.sources.scratch import new_folder


def weekly(events: DataFrame, late: str = "12 days") -> DataFrame:
    """Tumbling weeks from Monday; rows later than the watermark are dropped, and state is kept for open weeks only."""
    # windows are counted from the epoch, a Thursday: four days on is a Monday
    w = F.window("ts", "7 days", startTime="4 days")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def arrive(folder: str, *parts: DataFrame):
    """Writes each part into the folder and says so: a run of the stream takes what has arrived since the last."""
    for part in parts:
        part.write.mode("append").parquet(folder)
        yield part


def stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table through the stream, into a folder, in append mode: a week is emitted once the watermark has passed it.

    Then an event of a later year closes all weeks, and after it copies of the first day's events arrive: too late, they are dropped.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    first = events.agg(F.min(F.to_date("ts"))).first()[0]
    far = spark.range(1).select(F.make_timestamp(F.lit(2999), *[F.lit(x) for x in (1, 1, 0, 0, 0)]).cast(events.schema["ts"].dataType).alias("ts"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast(events.schema["value"].dataType).alias("value"))
    late = events.filter(F.to_date("ts") == F.lit(first))
    out = new_folder(spark, "weekly")
    for _ in arrive(f"{out}/arrivals", events, far, late):
        rows = weekly(spark.readStream.schema(events.schema).parquet(f"{out}/arrivals"))
        rows = rows.select(F.to_date("window.start").alias("week"), "event_type", "n", F.round("total", 4).alias("total"))
        rows.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")
