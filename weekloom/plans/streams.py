"""Streams that run over several micro-batches with restarts in between, against SQL over the whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.plans.queries import PANEL, panel, query, table
from weekloom.sources.scratch import new_folder
from weekloom.streaming.append import append_batch, append_stream, committed_records
from weekloom.streaming.stateful import detector_stream, run_arrivals

#: First days of the second and third arrival; weeks that come again late (in either), come twice, or come before their turn.
SECOND, THIRD, LATE, LATE_AGAIN, TWICE, EARLY = "1994-06-06", "1996-01-01", "1993-03-01", "1994-08-01", "1995-05-01", "1996-06-03"


@query(f"""WITH RECURSIVE {PANEL},
i AS (SELECT k, date, price, row_number() OVER (PARTITION BY k ORDER BY date) AS i, min(date) OVER (PARTITION BY k) AS f FROM p),
o AS (SELECT * FROM i WHERE datediff('day', f, date) = 7 * (i - 1)),
h AS (SELECT k, i, date, 1::DOUBLE AS n, price AS mean, -5.0::DOUBLE AS s, -5.0::DOUBLE AS low FROM o WHERE i = 1
  UNION ALL SELECT o.k, o.i, o.date, g.n + 1, g.mean + (price - g.mean) / (g.n + 1), g.s + price - (g.mean + (price - g.mean) / (g.n + 1)) - 5,
    least(g.low, g.s + price - (g.mean + (price - g.mean) / (g.n + 1)) - 5)
  FROM (SELECT k, i, CASE WHEN s - low > 3000 THEN 0 ELSE n END AS n, CASE WHEN s - low > 3000 THEN 0 ELSE mean END AS mean,
    CASE WHEN s - low > 3000 THEN 0 ELSE s END AS s, CASE WHEN s - low > 3000 THEN 0 ELSE low END AS low FROM h) g
  JOIN o ON o.k = g.k AND o.i = g.i + 1)
SELECT k, date, round(s - low, 4) AS path, s - low > 3000 AS changed, false AS rejected FROM h
UNION ALL SELECT k, date, NULL, NULL, true FROM p ANTI JOIN (SELECT k, date FROM o) u ON u.k = p.k AND u.date = p.date
UNION ALL SELECT k, date, NULL, NULL, true FROM p WHERE date IN ({", ".join(f"DATE '{x}'" for x in (LATE, LATE_AGAIN, TWICE, EARLY))})""")
def st7_restarted_detector(spark, d) -> DataFrame:
    """Change detection over three arrivals of the panel, the stream being stopped and started anew after each: weeks that repeat, come
    late or skip others are rejected, and what remains equals one run over the series."""
    p = panel(spark, d).select(F.col("k").cast("long").alias("key"), F.col("date").alias("day"), F.col("price").alias("value"))
    again = lambda *days: p.filter(F.col("day").isin(*[F.lit(x).cast("date") for x in days]))
    arrivals = [
        p.filter(F.col("day") < SECOND),
        p.filter((F.col("day") >= SECOND) & (F.col("day") < THIRD)).unionByName(again(LATE, TWICE, EARLY)),
        p.filter(F.col("day") >= THIRD).unionByName(again(LATE_AGAIN)),
    ]
    out = new_folder(spark, "detector")
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{out}/arrivals")
        stream = spark.readStream.schema(p.schema).parquet(f"{out}/arrivals")
        run_arrivals(detector_stream(stream, 5.0, 3000.0), out)
    found = spark.read.schema("key long, day date, path double, changed boolean, rejected boolean").parquet(f"{out}/rows")
    return found.select(F.col("key").cast("int").alias("k"), F.col("day").alias("date"), F.round("path", 4).alias("path"), "changed", "rejected")


@query("""WITH RECURSIVE e AS (SELECT user_id AS ledger, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence
  FROM events WHERE user_id IS NOT NULL),
h AS (SELECT ledger, sequence, event_id, sha256(coalesce(event_type, '') || '|') AS record_hash FROM e WHERE sequence = 1
  UNION ALL SELECT e.ledger, e.sequence, e.event_id, sha256(coalesce(e.event_type, '') || '|' || h.record_hash)
  FROM h JOIN e ON e.ledger = h.ledger AND e.sequence = h.sequence + 1)
SELECT * FROM h""")
def st2_append_ledger(spark, d) -> DataFrame:
    """Events as one ledger a user, appended by a stream in three arrivals with restarts; the second batch is replayed afterwards."""
    e = table(spark, d, "events").select(F.col("user_id").alias("ledger"), "event_id", "event_type")
    most = e.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    e = e.withColumn("part", F.floor(3 * F.col("event_id") / (most + 1)) + 1)
    out = new_folder(spark, "ledger-sink")
    for part in (1, 2, 3):
        e.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{out}/arrivals")
        append_stream(spark.readStream.schema(e.drop("part").schema).parquet(f"{out}/arrivals"), out, "ledger", "event_id", ["event_type"])
    append_batch(e.filter("part = 2").drop("part"), 1, out, "ledger", "event_id", ["event_type"])
    return committed_records(spark, out).select("ledger", "sequence", "event_id", "record_hash")
