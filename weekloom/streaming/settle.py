"""Delayed labels in a stream: forecasts meet their actuals through a stream-stream join with watermarks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.sources.scratch import new_folder


def settle_stream(forecasts: DataFrame, actuals: DataFrame, key: str, grace: str = "14 days", late: str = "12 days", how: str = "inner") -> DataFrame:
    """forecasts (key, issued) with actuals (key, at) in [issued, issued + grace]; state older than the watermarks is dropped.

    With how='leftOuter' a forecast without an actual is emitted once the watermark has passed its grace.
    """
    f = forecasts.withWatermark("issued", late).alias("f")
    a = actuals.withWatermark("at", late).alias("a")
    on = (F.col(f"f.{key}") == F.col(f"a.{key}")) & (F.col("a.at") >= F.col("f.issued")) & (F.col("a.at") <= F.col("f.issued") + F.expr(f"interval {grace}"))
    return f.join(a, on, how)


def stream_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases met by errors of the same user within a day; the sink is a folder, so nothing passes through the driver."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    f = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("issued"))
    a = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("at"))
    out = new_folder(spark, "settle")
    both = settle_stream(f, a, "user_id", "1 day").select("f.user_id", "purchase_id", "error_id")
    both.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, purchase_id bigint, error_id bigint").parquet(f"{out}/rows")


def stream_settle_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like ``stream_settle``, but purchases without an error within the day come out too, once the watermarks have passed their grace.

    After the events, a purchase and an error of a later year arrive, which close all that went before; they are left out (they have no
    event_id, but a key: rows without one never reach the watermarks of an equi-join).
    """
    from .weekly import arrive

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    far = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(None).cast("long").alias("event_id"), F.explode(F.array(F.lit("purchase"), F.lit("error"))).alias("event_type"), F.make_timestamp(F.lit(2999), *[F.lit(x) for x in (1, 1, 0, 0, 0)]).alias("ts"))
    out = new_folder(spark, "grace")
    for _ in arrive(f"{out}/arrivals", events, far, far):
        e = spark.readStream.schema(events.schema).parquet(f"{out}/arrivals")
        f = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("issued"))
        a = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("at"))
        both = settle_stream(f, a, "user_id", "1 day", how="leftOuter").select("f.user_id", "purchase_id", "error_id")
        both.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, purchase_id bigint, error_id bigint").parquet(f"{out}/rows").filter("purchase_id is not null")
