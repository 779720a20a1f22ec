"""Ledgers, decisions, text and files: hand-computed values, NULLs, ties, empty tables."""
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from weekloom.operators import decide, ledger, score, text
from weekloom.sources import files

DAY = dt.date(2024, 1, 1)


def test_ledger_breaks_are_found(spark):
    rows, before = [], ""
    for i in range(1, 6):
        h = hashlib.sha256(f"{before}|p{i}".encode()).hexdigest()
        rows.append(["a", i, f"p{i}", before, h])
        before = h
    schema = "ledger string, sequence long, payload string, previous_hash string, record_hash string"
    check = lambda r: tuple(ledger.verify_ledger(spark.createDataFrame([tuple(x) for x in r], schema), ["ledger"], "sequence", ["previous_hash", "payload"]).first())
    assert check(rows) == ("a", 5, 0, 0, 0)
    changed = [list(r) for r in rows]
    changed[2][2] = "forged"
    assert check(changed) == ("a", 5, 1, 0, 0)
    assert check(rows[:2] + rows[3:]) == ("a", 4, 0, 1, 2)


def test_issue_settle_review(spark):
    s = "k int, target_date date, sequence long, event string, artifact string, origin double, prediction double, lower double, upper double"
    week = lambda i: DAY + dt.timedelta(days=7 * i)
    old = spark.createDataFrame([(1, week(0), 1, "forecast_issued", "x", 1.0, 2.0, 1.0, 3.0), (1, week(1), 2, "forecast_issued", "x", 1.0, 2.0, 1.0, 3.0), (1, week(1), 3, "forecast_revision", "y", 1.0, 5.0, 4.0, 6.0), (1, week(0), 4, "forecast_realized", "x", 1.0, 2.0, 1.0, 3.0)], s)
    new = spark.createDataFrame([(1, week(0), "x"), (1, week(1), "x"), (1, week(2), None)], "k int, target_date date, artifact string")
    got = {r["target_date"]: r["event"] for r in ledger.issue_forecasts(old, new, ["k", "target_date"]).collect()}
    assert got == {week(1): "forecast_revision", week(2): "forecast_issued"}
    seen = spark.createDataFrame([(1, week(0), 2.0), (1, week(1), 5.5)], "k int, target_date date, actual double")
    done = ledger.settle(old, seen, ["k", "target_date"])
    assert [(r["target_date"], r["abs_error"], r["inside"]) for r in done.collect()] == [(week(1), 0.5, True)]
    r = ledger.review_ledger(ledger.latest_issued(old, ["k", "target_date"]), done, ["k"], "target_date", F.lit("2024-03-01").cast("date")).first()
    assert (r["issued"], r["settled"], r["pending"], r["weeks_pending"], r["level"]) == (2, 1, 1, 8, "critical")


def test_decide(spark):
    f = spark.createDataFrame([(1, DAY, 10.0, 12.0)], "k int, target_date date, origin double, prediction double")
    c = spark.createDataFrame([(1, "p", 100.0, "state"), (1, "q", None, "national")], "k int, customer string, volume double, scope string")
    for when, agrees, level in ((DAY, True, ["medium", "high"]), (DAY + dt.timedelta(days=7), None, ["low", "low"])):
        ch = spark.createDataFrame([(1, when, 11.0)], "k int, target_date date, challenger double")
        got = decide.decide(f, ch, c, ["k", "target_date"], 1.0, 0.5).orderBy("customer").collect()
        assert [r["agreement"] for r in got] == [agrees] * 2 and [r["confidence"] for r in got] == level
        assert (got[0]["liters"], got[0]["saving"]) == (50.0, 100.0) and got[1]["liters"] is None
    assert decide.decide(f, ch, c, ["k", "target_date"], 2.0, 0.5).first()["recommend"] == "wait"


def test_weights_and_ranks(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0, 2.0), (1, 2.0, 4.0, 3.0), (1, None, 4.0, 3.0)], "k int, a double, b double, y double")
    got = score.convex_weights(df, ["k"], ["a", "b"], "y").first()
    assert (got["w_a"], got["w_b"], got["mae"]) == (0.5, 0.5, 0.0)
    df = spark.createDataFrame([(1, float(i), float(i * i)) for i in range(20)], "k int, a double, b double")
    assert score.residual_redundancy(df, ["k"], "a", "b").first()["spearman"] == pytest.approx(1.0)
    with pytest.raises(Exception, match="several rows"):
        score.weekly_reduce(spark.createDataFrame([(1, DAY, 1.0), (1, DAY, 2.0)], "k int, d date, v double"), ["k"], "d", "v", "preserve").collect()


def test_weekly_documents(spark):
    rows = [(1, "s", "Título", "Um  texto", "h1", dt.datetime(2024, 1, 2)), (2, "s", "again", "x", "h1", dt.datetime(2024, 1, 3)), (3, None, None, None, "h2", dt.datetime(2024, 1, 1, 12))]
    a = spark.createDataFrame(rows, "record_id int, source string, title string, body string, sha string, available timestamp")
    o = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 3, 3),)], "origin date")
    got = {r["origin"]: (r["n"], r["document"]) for r in text.weekly_documents(a, o, 7, "record_id", "source", "title", "body").collect()}
    assert got[dt.date(2024, 1, 7)] == (2, "source_  \nsource_s titulo um texto") and got[dt.date(2024, 3, 3)] == (0, text.NO_NEWS)


def test_annotation(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i < 6) for i in range(20)], "id int, s string, rel boolean")
    got = text.annotation_batch(df, ["s"], "id", F.col("rel"), 12, 2 / 3, 2, 1)
    counts = {r["pool"]: r["count"] for r in got.groupBy("pool").count().collect()}
    assert counts == {"relevant": 12, "control": 12}  # only six relevant ones, in two slots
    assert got.select("item_id").distinct().count() == 12
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, l string")
    b = spark.createDataFrame([(1, "y"), (2, None)], "id int, l string")
    assert sorted(r["id"] for r in text.disagreements(a, b, "id", ["l"]).collect()) == [1, 3]


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Data;Produto;Preço Médio\n05/01/2020;DIESEL S10;4,37\n2020-01-12;Diesel S-500;R$ 1.234,5\nx;DIESEL S10;1\n05/01/2020;GASOLINA;3\n05/01/2020;DIESEL S10;-1\n")
    ok, bad = files.read_price_csv(spark, str(tmp_path / "p.csv"))
    assert sorted(map(tuple, ok.collect())) == [("S10", dt.date(2020, 1, 5), 4.37), ("S500", dt.date(2020, 1, 12), 1234.5)] and bad.count() == 3
    (tmp_path / "v.json").write_text('{"value": [{"VALDATA": "2020-01-05T00:00:00-03:00", "VALVALOR": 2.5}, {"VALDATA": "2020-01-06T00:00:00-03:00", "VALVALOR": null}]}')
    assert [tuple(r) for r in files.read_series_json(spark, str(tmp_path / "v.json"), "values").collect()] == [(dt.date(2020, 1, 5), 2.5)]
    (tmp_path / "c.jsonl").write_text('{"id": 1, "t": "a"}\n{"id": 2, "t": "b", "more": 1}\nnot json\n{"id": 1, "t": "c"}\n{"id": null, "t": "d"}\n{"id": 3, "t": "e"}\n')
    from pyspark.sql.types import StructType

    ok, v = files.read_contract_jsonl(spark, str(tmp_path / "c.jsonl"), StructType.fromDDL("id bigint, t string"), "id")
    assert [tuple(r) for r in ok.collect()] == [(3, "e")] and {r["rule"]: r["violations"] for r in v.collect()} == {"unreadable": 1, "fields": 1, "missing_id": 1, "repeated_id": 1}
    df = spark.createDataFrame([(1, "=1+1", "k"), (2, None, "k"), (3, "plain", "k")], "i int, t string, g string")
    files.write_table(df, str(tmp_path / "out"), "csv")
    assert {r["t"] for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()} == {"'=1+1", None, "plain"}
    one = lambda d: files.data_fingerprint(d, ["g"], ["i", "t"]).first()["fingerprint"]
    assert one(df) == one(df.orderBy(F.desc("i")).repartition(3)) != one(df.union(df.limit(1)))


def test_settling_stream(spark, tmp_path):
    from weekloom.streaming.settle import stream_settle

    rows = [(1, dt.datetime(2024, 1, 1), 7, "purchase"), (2, dt.datetime(2024, 1, 1, 20), 7, "error"), (3, dt.datetime(2024, 1, 3), 7, "error"), (4, dt.datetime(2024, 1, 1, 5), 8, "error")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in stream_settle(spark, str(tmp_path)).collect()] == [(7, 1, 2)]


def test_streamed_detector_equals_the_batch(spark, tmp_path):
    from weekloom.operators.learn import page_hinkley
    from weekloom.streaming.online import stream_page_hinkley

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 3, None if i == 7 else float((i * 37) % 11 + (30 if i > 60 else 0))) for i in range(120)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: (round(r["path"], 9), r["changed"], r["rejected"]) for r in stream_page_hinkley(spark, str(tmp_path), 0.5, 60.0).collect()}
    batch = page_hinkley(e.withColumnRenamed("ts", "date"), ["user_id"], "value", 0.5, 60.0).join(e.withColumnRenamed("ts", "date"), ["user_id", "date"])
    assert got == {r["event_id"]: (round(r["path"], 9), r["changed"] == 1.0, False) for r in batch.collect()}
    assert any(v[1] for v in got.values())


def test_manifest_and_repeated_ids(spark, tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.jsonl").write_text('{"id": 1, "t": "a"}\n{"id": 2, "t": "b"}\n\n{"id": 2, "t": "c"}\n')
    (tmp_path / "c" / "b.jsonl").write_text('{"id": 3, "t": "x"}\n')
    schema, found = StructType.fromDDL("id bigint, t string"), files.file_profile(spark, str(tmp_path / "c"))
    assert {r["file"]: r["records"] for r in found.collect()} == {"a.jsonl": 3, "b.jsonl": 1}
    ok, v = files.read_contract_jsonl(spark, str(tmp_path / "c"), schema, "id", manifest=found.select("file", "records", "sha256"))
    assert sorted(r["id"] for r in ok.collect()) == [1, 3]
    assert {r["rule"]: r["violations"] for r in v.collect() if r["violations"]} == {"repeated_id": 1}
    stated = spark.createDataFrame([tuple(r) for r in found.select("file", "records", "sha256").collect()], "file string, records long, sha256 string")
    (tmp_path / "c" / "b.jsonl").write_text('{"id": 3, "t": "y"}\n{"id": 4, "t": "y"}\n')
    (tmp_path / "c" / "d.jsonl").write_text("\n")
    v = files.read_contract_jsonl(spark, str(tmp_path / "c"), schema, "id", manifest=stated)[1]
    assert {r["rule"]: r["violations"] for r in v.collect() if r["violations"]} == {"repeated_id": 1, "record_count": 1, "file_sha256": 1, "undeclared_file": 1}


def test_ledger_alerts(spark):
    rows = [("a", f"2020-01-{d:02d}", 1.0, 0.5, d % 2 == 0) for d in range(1, 27)] + [("b", "2020-01-01", 0.1, 0.5, True)]
    done = spark.createDataFrame(rows, "k string, t string, abs_error double, base_error double, inside boolean").selectExpr("k", "to_date(t) AS target", "abs_error", "base_error", "inside")
    issued = done.select("k", "target").unionByName(spark.sql("SELECT 'b' AS k, DATE'2020-01-20' AS target UNION ALL SELECT 'c', DATE'2020-03-01'"))
    got = {r["k"]: (r["level"], [(a["level"], a["code"]) for a in r["alerts"]]) for r in ledger.review_ledger(issued, done, ["k"], "target", F.lit("2020-02-24").cast("date")).collect()}
    assert got["a"] == ("critical", [("critical", "worse_than_naive"), ("warning", "coverage"), ("info", "goal_reached")])
    assert got["b"] == ("critical", [("critical", "late_settlement")]) and got["c"] == ("ok", [])


def test_stream_drops_late_rows(spark, tmp_path):
    """State goes over from run to run; a row that comes after its week was closed changes nothing."""
    from weekloom.streaming import weekly

    schema = "ts timestamp, event_type string, value double"
    batch = lambda *rows: spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("to_timestamp(ts) AS ts", "event_type", "value")
    parts = [batch(("2024-01-02 10:00:00", "a", 1.0), ("2024-01-10 10:00:00", "a", 2.0)), batch(("2024-06-03 10:00:00", "a", 4.0)), batch(("2024-01-03 10:00:00", "a", 8.0), ("2024-06-04 10:00:00", "a", 16.0)), batch(("2024-12-30 10:00:00", "b", 0.0))]
    for _ in weekly.arrive(str(tmp_path / "in"), *parts):
        rows = weekly.weekly(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).select("window.start", "event_type", "n", "total")
        rows.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(str(r["start"])[:10], r["event_type"]): (r["n"], r["total"]) for r in spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01", "a"): (1, 1.0), ("2024-01-08", "a"): (1, 2.0), ("2024-06-03", "a"): (2, 20.0)}
