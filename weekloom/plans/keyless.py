"""Queries over single series: tables without a key, scanned in ranges.

Daily table: per day of shipping, the mean price a unit and the mean value of that day's orders; money is summed in cents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators import align, features
from weekloom.plans.queries import cents, cost, query, table

DAILY = """c AS (SELECT o_orderdate::DATE AS date, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / (100 * count(o_totalprice)) AS cost
  FROM orders GROUP BY 1),
s AS (SELECT l_shipdate::DATE AS date, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / (100 * sum(l_quantity)) AS price
  FROM lineitem GROUP BY 1),
d AS (SELECT s.date, s.price, c.cost FROM s JOIN c ON c.date = s.date)"""


def daily(spark, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    x = x.groupBy("date").agg((cents("l_extendedprice") / (100 * F.sum("l_quantity"))).alias("price"))
    return x.join(cost(spark, d), "date")


@query(f"""WITH {DAILY}
SELECT l_orderkey, l_linenumber, l_partkey, c.cost FROM lineitem l ASOF LEFT JOIN c ON l.l_shipdate::DATE >= c.date""")
def jn2_asof_keyless(spark, d):
    """The last day's order value known when each item was shipped: all items and days are one series."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("date"))
    return align.asof_backward(items, cost(spark, d), [], ["cost"]).drop("date")


@query(f"""WITH {DAILY}, w AS (SELECT date, price, cost, ln(price) - ln(lag(price) OVER (ORDER BY date)) AS cp,
  ln(cost) - ln(lag(cost) OVER (ORDER BY date)) AS cc FROM d)
SELECT date, lag(price, 1) OVER o AS price_l1, lag(price, 12) OVER o AS price_l12, lag(cost, 8) OVER o AS cost_l8,
  CASE WHEN count(price) OVER f12 >= 12 THEN round(avg(price) OVER f12, 6) END AS price_ma12,
  CASE WHEN count(price) OVER f4 >= 4 THEN round(avg(price) OVER f4, 6) END AS price_ma4,
  CASE WHEN count(cp) OVER f8 >= 4 THEN round(stddev_samp(cp) OVER f8, 6) END AS price_vol8,
  CASE WHEN count(cc) OVER f12 >= 6 THEN round(stddev_samp(cc) OVER f12, 6) END AS cost_vol12
FROM w WINDOW o AS (ORDER BY date), f4 AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
  f8 AS (ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), f12 AS (ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def wf1_features_keyless(spark, d):
    f = features.weekly_features(daily(spark, d), [], ["price", "cost"])
    rolled = ["price_ma4", "price_ma12", "price_vol8", "cost_vol12"]
    return f.select("date", "price_l1", "price_l12", "cost_l8", *[F.round(c, 6).alias(c) for c in rolled])


@query(f"""WITH {DAILY}, l AS (SELECT date, ln(price) AS y, ln(cost) AS x FROM d),
m AS (SELECT *, count(*) OVER w AS n, regr_slope(y, x) OVER w AS b, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM l
  WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT date, CASE WHEN n >= 52 THEN y - my - b * (x - mx) END AS r FROM m),
v AS (SELECT date, r, count(r) OVER w AS n, stddev_samp(r) OVER w AS sd FROM r
  WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT date, CASE WHEN n >= 2 THEN round(r / sd, 3) + 0.0 END AS coint FROM v""")
def wf6_coint_keyless(spark, d):
    f = features.expanding_coint_residual(daily(spark, d), [], "price", "cost", 52)
    return f.select("date", (F.round("coint", 3) + 0.0).alias("coint"))


@query(f"""WITH {DAILY}, n AS (SELECT date, coalesce((datediff('day', lag(date) OVER (ORDER BY date), date) <> 1)::INT, 1) AS n FROM d WHERE price > 1450),
b AS (SELECT date, sum(n) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM n),
z AS (SELECT *, count(*) OVER (PARTITION BY block) AS m FROM b) SELECT date, block FROM z WHERE m >= 3""")
def wf13_blocks_keyless(spark, d):
    return features.contiguous_blocks(daily(spark, d).filter("price > 1450"), [], 1).select("date", "block")


@query(f"""WITH {DAILY}, e AS (SELECT date, coalesce((datediff('day', lag(date) OVER (ORDER BY date), date) > 14)::INT, 1) AS n FROM d WHERE price > 1550)
SELECT date, sum(n) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM e""")
def wf14_episodes_keyless(spark, d):
    return features.episodes(daily(spark, d), [], F.col("price") > 1550, 2).select("date", "episode")
