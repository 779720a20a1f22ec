"""Registered queries: sources (over files that Spark writes from the given tables), ledgers and the settling stream."""
from __future__ import annotations


from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weekloom.operators import align, ledger
from weekloom.plans.queries import COST, PANEL, PRED, cost, panel, predictions, query, rounded, table
from weekloom.sources import files
from weekloom.sources.scratch import new_folder


@query(f"WITH {PANEL} SELECT CASE WHEN k < 12 THEN 'S10' ELSE 'S500' END AS product, date, round(price / 3.785411784, 2) AS price FROM p")
def src1_read_price_csv(spark, d):
    path = new_folder(spark, "prices")
    price = F.replace(F.format_string("R$ %.2f", F.round(F.col("price") / 3.785411784, 2)), F.lit("."), F.lit(","))
    name = F.when(F.col("k") < 12, "Óleo Diesel S10").otherwise("DIESEL S-500")
    panel(spark, d).select(F.date_format("date", "dd/MM/yyyy").alias("Data"), name.alias("Produto"), price.alias("Preço Médio")).write.csv(path, sep=";", header=True)
    return files.read_price_csv(spark, path)[0]


@query(f"WITH {PANEL}, x AS (SELECT CASE WHEN k < 12 THEN 'S10' ELSE 'S500' END AS product, date, round(price / 3.785411784, 2) AS price FROM p WHERE k % 12 < 6) SELECT product, (date + INTERVAL 6 DAY)::DATE AS week_end, round(median(price), 6) AS price FROM x GROUP BY 1, 2")
def src1_weekly_prices(spark, d):
    path = new_folder(spark, "prices")
    price = F.replace(F.format_string("%.2f", F.round(F.col("price") / 3.785411784, 2)), F.lit("."), F.lit(","))
    x = panel(spark, d).filter("k % 12 < 6").select(F.date_format("date", "dd/MM/yyyy").alias("Data"), F.when(F.col("k") < 12, "Diesel S10").otherwise("Diesel S500").alias("Produto"), price.alias("Preço Médio"))
    x.write.csv(path, sep=";", header=True)
    return rounded(files.read_price_csv(spark, path, weekly="median")[0])


@query(f"WITH {COST} SELECT date, cost AS value FROM c")
def src2_read_series_json(spark, d):
    path = new_folder(spark, "series")
    month = cost(spark, d).groupBy(F.trunc("date", "month").alias("m")).agg(F.sort_array(F.collect_list(F.struct("date", "cost"))).alias("x"))  # at most 31 days
    quote = F.struct(F.array(F.struct(F.transform("x", lambda r: r["cost"]).alias("close"))).alias("quote"))
    month.select(F.struct(F.array(F.struct(F.transform("x", lambda r: F.unix_timestamp(r["date"].cast("timestamp"))).alias("timestamp"), quote.alias("indicators"))).alias("result")).alias("chart")).write.json(path)
    return files.read_series_json(spark, path, "chart")


@query("SELECT doc_id, source, sha256(text) AS content_sha256 FROM documents WHERE text IS NOT NULL")
def src3_read_contract_jsonl(spark, d):
    path = new_folder(spark, "contract")
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))
    x.write.json(path, ignoreNullFields=False)
    ok, _ = files.read_contract_jsonl(spark, path, StructType.fromDDL("doc_id bigint, source string, content_sha256 string"), "doc_id")
    return ok


@query("""WITH x AS (SELECT * FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM x)
SELECT unnest(['unreadable', 'fields', 'missing_id', 'repeated_id', 'record_count', 'file_sha256', 'undeclared_file', 'missing_file']) AS rule, unnest([count(*) FILTER (doc_id % 200 = 3), count(*) FILTER (doc_id % 50 = 1), count(*) FILTER (doc_id % 250 = 4),
  count(*) FILTER (doc_id % 100 = 2), 1, 1, 1, 1]) AS violations FROM x""")
def src3_contract_violations(spark, d):
    """Documents as contract lines, some of them broken, repeated or without an id, in three files; the manifest states a wrong count for
    the first file and a wrong SHA-256 for the second, leaves out the third and names one that isn't there."""
    path = new_folder(spark, "contract")
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))
    rest = (F.col("source"), F.col("content_sha256"))
    line = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    text = F.when(F.col("doc_id") % 200 == 3, F.substring(line("doc_id", *rest), 1, 10)).when(F.col("doc_id") % 50 == 1, line("doc_id", *rest, F.lit(1).alias("more"))).when(F.col("doc_id") % 250 == 4, line(F.lit(None).cast("long").alias("doc_id"), *rest)).otherwise(line("doc_id", *rest))
    x.withColumn("n", F.when(F.col("doc_id") % 100 == 2, 2).otherwise(1)).select(text.alias("value"), F.explode(F.sequence(F.lit(1), "n"))).drop("col").repartition(3).write.text(path)
    found = files.file_profile(spark, path)
    nth = F.row_number().over(W.orderBy("file"))  # three files
    m = found.withColumn("i", nth).filter("i < 3").select("file", (F.col("records") + F.when(F.col("i") == 1, 1).otherwise(0)).alias("records"), F.when(F.col("i") == 2, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    m = m.unionByName(spark.range(1).select(F.lit("gone.txt").alias("file"), F.lit(1).cast("long").alias("records"), F.lit("0" * 64).alias("sha256")))
    return files.read_contract_jsonl(spark, path, StructType.fromDDL("doc_id bigint, source string, content_sha256 string"), "doc_id", manifest=m)[1]


def ledger_rows(spark, d):
    """Events as ledgers by user, numbered by id but linked in order of time, so that some links are broken."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("ledger"), F.col("event_id").alias("id"), F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("payload"), "ts")
    e = e.withColumn("record_hash", ledger.record_hash(["event", "payload"]))
    by = W.partitionBy("ledger")
    return e.withColumns({"sequence": F.row_number().over(by.orderBy("id")).cast("long"), "previous_hash": F.lag("record_hash", 1).over(by.orderBy("ts", "id"))})


def chained(spark, d):
    """Events as ledgers by user, each record's hash over its content and the hash before it; then some are tampered with: a changed
    payload where the id is a multiple of 97, a changed link of 89, a changed number of 83."""
    e = table(spark, d, "events").select(F.col("user_id").alias("ledger"), F.col("event_id").alias("id"), F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("payload"))

    # a fold over the sorted records of a ledger: the hash so far, and the records with their links
    own = F.array_sort(F.collect_list(F.struct("id", "event", "payload")))
    none = F.array().cast("array<struct<id: bigint, event: string, payload: string, previous_hash: string, record_hash: string>>")

    def link(a, x):
        made = F.sha2(F.concat_ws("|", x["event"], x["payload"], a["before"]), 256)
        record = F.struct(x["id"], x["event"], x["payload"], F.nullif(a["before"], F.lit("")).alias("previous_hash"), made.alias("record_hash"))
        return F.struct(made.alias("before"), F.concat(a["out"], F.array(record)).alias("out"))

    folded = F.aggregate("_own", F.struct(F.lit("").alias("before"), none.alias("out")), link)["out"]
    x = e.groupBy("ledger").agg(own.alias("_own")).select("ledger", F.posexplode(folded).alias("sequence", "_r"))
    x = x.select("ledger", "_r.*", (F.col("sequence") + 1).cast("long").alias("sequence"))
    bad = lambda n: F.col("id") % n == 0
    return x.withColumns({"payload": F.when(bad(97), F.concat("payload", F.lit("x"))).otherwise(F.col("payload")), "previous_hash": F.when(bad(89), "x").otherwise(F.col("previous_hash")), "sequence": F.when(bad(83), F.col("sequence") + 1).otherwise(F.col("sequence"))})


CHAIN = "e AS (SELECT user_id::VARCHAR AS ledger, event_id AS id, event_type AS event, event_id::VARCHAR AS payload, ts, sha256(event_type || '|' || event_id) AS h FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY id) AS sequence, lag(h) OVER (PARTITION BY ledger ORDER BY ts, id) AS ph FROM e)"


@query(f"WITH {CHAIN} SELECT ledger, sequence, event, payload, ph AS previous_hash, h AS record_hash FROM l")
def src4_read_ledger(spark, d):
    path = new_folder(spark, "ledger")
    ledger_rows(spark, d).drop("ts", "id").write.json(path)
    return files.read_ledger(spark, path).drop("line")


@query("SELECT user_id AS ledger, count(*) AS records, count(*) FILTER (event_id % 97 = 0 OR event_id % 89 = 0) AS bad_hash, count(*) FILTER (event_id % 89 = 0) AS bad_link, count(*) FILTER (event_id % 83 = 0) AS bad_sequence FROM events GROUP BY 1")
def st1_verify_ledger(spark, d):
    return ledger.verify_ledger(chained(spark, d), ["ledger"], "id", ["event", "payload", "previous_hash"])


@query(f"WITH {PANEL} SELECT n_name AS uf, date, price, stations FROM p JOIN nation ON n_nationkey = k")
def src5_read_state_prices(spark, d):
    states = table(spark, d, "nation").select(F.upper("n_name").alias("name"), F.col("n_name").alias("uf"), F.col("n_nationkey").alias("k"))
    raw = panel(spark, d).join(states, "k").select(F.lower("name").alias("estado"), F.lit("OLEO DIESEL S10").alias("produto"), F.lit("R$/l").alias("unidade"), "date", "price", "stations")
    ok, _ = files.read_state_prices(raw, states.select("name", "uf"), "estado", "produto", "unidade", "date", "price", "stations")
    return ok


@query(f"""WITH {PANEL} SELECT (date - INTERVAL 1 DAY)::DATE AS date, round(median(price) / 3.785411784, 6) AS producer_national,
  max(price) FILTER (k = 1) AS producer_region FROM p WHERE k < 25 GROUP BY date""")
def src6_read_producer(spark, d):
    """A producer's table with a column for each of the 25 nations."""
    regions = [f"r{k}" for k in range(25)]
    w = panel(spark, d).groupBy("date").pivot("k", list(range(25))).agg(F.max("price")).toDF("date", *regions)
    x = files.read_producer(w.withColumn("produto", F.lit("Diesel S10")), "produto", "date", regions, "r1")
    return x.withColumn("producer_national", F.round(F.col("producer_national") / 3.785411784, 6))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '''=' ELSE '' END || event_type AS label FROM events")
def src7_write_csv_safe(spark, d):
    path = new_folder(spark, "safe")
    files.write_table(table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type")).alias("label")), path, "csv")
    return spark.read.schema("event_id bigint, label string").csv(path, header=True, escape='"')


@query("""WITH h AS (SELECT *, sha256(doc_id || '|' || coalesce(text, '\\N') || '|' || coalesce(lang, '\\N')) AS h FROM documents),
p AS (SELECT source, count(*) AS n, min(doc_id) AS a, max(doc_id) AS z, count(text) AS n_text, count(lang) AS n_lang, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS n_bytes, concat_ws(':', sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 17, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 25, 8))::BIGINT)::VARCHAR) AS s FROM h GROUP BY 1)
SELECT source, n AS "rows", a AS "first", z AS "last", n_text, n_lang, n_bytes AS bytes, sha256(s) AS fingerprint FROM p""")
def src8_source_profile(spark, d):
    return files.source_profile(table(spark, d, "documents").select("source", "doc_id", "text", "lang"), ["source"], "doc_id", "text")


@query("WITH h AS (SELECT event_type, sha256(user_id || '|' || event_id) AS h FROM events), p AS (SELECT event_type, count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR AS a, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR AS b, sum(('0x' || substr(h, 17, 8))::BIGINT)::VARCHAR AS c, sum(('0x' || substr(h, 25, 8))::BIGINT)::VARCHAR AS d FROM h GROUP BY 1) SELECT event_type, n AS \"rows\", sha256(a || ':' || b || ':' || c || ':' || d) AS fingerprint FROM p")
def src9_data_fingerprint(spark, d):
    return files.data_fingerprint(table(spark, d, "events"), ["event_type"], ["user_id", "event_id"])


ISSUED = PRED + ", fc AS (SELECT k, target_date, actual, origin, prediction, origin - 400 AS lower, origin + 400 AS upper, year(target_date) AS y FROM r)"


def forecasts(spark, d):
    """Issued: forecasts up to 2000 (up to 1999 realised)."""
    p = predictions(spark, d).withColumns({"lower": F.col("origin") - 400, "upper": F.col("origin") + 400, "artifact": F.floor("prediction").cast("string"), "sequence": F.datediff("target_date", F.lit("1990-01-01").cast("date"))})
    return p, p.filter(F.year("target_date") <= 2000).withColumn("event", F.lit("forecast_issued"))


@query(f"WITH {ISSUED} SELECT k, target_date, floor(prediction / 2 + origin / 2)::BIGINT::VARCHAR AS artifact, CASE WHEN y > 2000 THEN 'forecast_issued' ELSE 'forecast_revision' END AS event FROM fc WHERE y > 2000 OR floor(prediction / 2 + origin / 2) <> floor(prediction)")
def st2_issue_forecasts(spark, d):
    p, issued = forecasts(spark, d)
    new = p.select("k", "target_date", F.floor(F.col("prediction") / 2 + F.col("origin") / 2).cast("string").alias("artifact"))
    return ledger.issue_forecasts(issued, new, ["k", "target_date"]).select("k", "target_date", "artifact", "event")


def settled(spark, d):
    p, issued = forecasts(spark, d)
    done = issued.filter(F.year("target_date") == 1995).withColumn("event", F.lit("forecast_realized"))
    return issued.drop("actual"), ledger.settle(issued.drop("actual").unionByName(done.drop("actual")), p.filter(F.year("target_date") <= 1999), ["k", "target_date"])


@query(f"WITH {ISSUED} SELECT k, target_date, round(abs(prediction - actual), 5) AS abs_error, actual BETWEEN lower AND upper AS inside FROM fc WHERE y BETWEEN 1996 AND 1999")
def st3_settle(spark, d):
    return rounded(settled(spark, d)[1].select("k", "target_date", "abs_error", "inside"), 5)


@query(f"WITH {ISSUED}, s AS (SELECT *, y BETWEEN 1996 AND 1999 AS d FROM fc WHERE y <= 2000), o AS (SELECT k, count(*) AS issued, count(*) FILTER (d) AS settled, count(*) FILTER (NOT d) AS pending, max(greatest(floor(datediff('day', target_date, DATE '2001-01-08') / 7), 0)) FILTER (NOT d) AS weeks_pending, avg((actual BETWEEN lower AND upper)::INT::DOUBLE) FILTER (d) AS coverage, avg(abs(prediction - actual)) FILTER (d) AS mae, avg(abs(origin - actual)) FILTER (d) AS b FROM s GROUP BY k) SELECT k, issued, settled, pending, weeks_pending::BIGINT AS weeks_pending, round(coverage, 6) AS coverage, round(mae, 6) AS mae, CASE WHEN weeks_pending > 30 OR settled >= 20 AND mae > b THEN 'critical' WHEN settled >= 20 AND abs(coverage - 0.8) > 0.1 THEN 'warning' WHEN settled >= 60 THEN 'info' ELSE 'ok' END AS level, concat_ws(',', CASE WHEN weeks_pending > 30 THEN 'late_settlement' END, CASE WHEN settled >= 20 AND mae > b THEN 'worse_than_naive' END, CASE WHEN settled >= 20 AND abs(coverage - 0.8) > 0.1 THEN 'coverage' END, CASE WHEN settled >= 60 THEN 'goal_reached' END) AS alerts FROM o")
def st4_review_ledger(spark, d):
    issued, done = settled(spark, d)
    x = ledger.review_ledger(issued, done, ["k"], "target_date", F.lit("2001-01-08").cast("date"), late_weeks=30, goal=60).drop("base_mae")
    return rounded(x.withColumn("alerts", F.concat_ws(",", F.transform("alerts", lambda a: a["code"]))))


@query("SELECT f.user_id, f.event_id AS purchase_id, a.event_id AS error_id FROM events f LEFT JOIN events a ON a.user_id = f.user_id AND a.ts >= f.ts AND a.ts <= f.ts + INTERVAL 1 DAY AND a.event_type = 'error' WHERE f.event_type = 'purchase'")
def st6_stream_settle_grace(spark, d):
    from weekloom.streaming.settle import stream_settle_grace

    return stream_settle_grace(spark, d)


@query("SELECT f.user_id, f.event_id AS purchase_id, a.event_id AS error_id FROM events f JOIN events a ON a.user_id = f.user_id AND a.ts >= f.ts AND a.ts <= f.ts + INTERVAL 1 DAY WHERE f.event_type = 'purchase' AND a.event_type = 'error'")
def st6_stream_settle(spark, d):
    from weekloom.streaming.settle import stream_settle

    return stream_settle(spark, d)


@query("""WITH RECURSIVE i AS (SELECT user_id AS k, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
h AS (SELECT DISTINCT k, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0::DOUBLE AS n, 0::DOUBLE AS mean, 0::DOUBLE AS s, 0::DOUBLE AS low, false AS hit FROM i
  UNION ALL SELECT k, i, event_id, n, mean, s, low, v IS NOT NULL AND s - low > 200 FROM (SELECT *, least(low0, s) AS low FROM (SELECT *, CASE WHEN v IS NULL THEN s0 ELSE s0 + v - mean - 0.5 END AS s
    FROM (SELECT *, CASE WHEN v IS NULL THEN mean0 ELSE mean0 + (v - mean0) / n END AS mean FROM (SELECT i.k, i.i, i.event_id, v, CASE WHEN hit THEN 0 ELSE n END + (v IS NOT NULL)::INT AS n,
      CASE WHEN hit THEN 0 ELSE mean END AS mean0, CASE WHEN hit THEN 0 ELSE s END AS s0, CASE WHEN hit THEN 0 ELSE low END AS low0 FROM h JOIN i ON i.k = h.k AND i.i = h.i + 1)))))
SELECT k AS key, event_id, round(s - low, 6) AS path, hit AS changed, false AS rejected FROM h WHERE i > 0""")
def st7_stream_page_hinkley(spark, d):
    from weekloom.streaming.online import stream_page_hinkley

    return rounded(stream_page_hinkley(spark, d))


@query()
def st7_stream_conformal(spark, d):
    from weekloom.streaming import online

    p = align.weekly_grid(predictions(spark, d).drop("target_date"), ["k"]).select(F.col("k").cast("long").alias("key"), F.col("date").alias("day"), "actual", F.col("prediction").alias("point"))
    return rounded(online.settle(online.conformal_stream(online.staged_stream(spark, p)), spark), 4)


@query()
def st7_stream_learner(spark, d):
    from weekloom.streaming import online

    p = align.weekly_grid(predictions(spark, d).drop("target_date"), ["k"])
    p = p.select(F.col("k").cast("long").alias("key"), F.col("date").alias("day"), (F.col("origin") - F.col("prediction")).alias("gap"), "origin", "actual")
    return rounded(online.settle(online.learner_stream(online.staged_stream(spark, p), ["gap", "origin"], "actual"), spark), 2)
