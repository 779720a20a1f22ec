"""Named state: rejections row by row, restarts, and a batch's state as the first one."""
import datetime as dt

import pytest

from weekloom.operators import learn
from weekloom.streaming.stateful import STORE, detector_stream, run_arrivals

DAY = dt.date(2020, 1, 6)
SCHEMA = "key long, day date, value double"


def week(i):
    return DAY + dt.timedelta(weeks=i)


def feed(spark, folder, arrivals, initial=None):
    """Each arrival is a micro-batch of its own, with a restart before it."""
    for rows in arrivals:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        run_arrivals(detector_stream(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), 0.1, 5.0, initial), str(folder))
    return spark.read.parquet(f"{folder}/rows").collect()


VALUES = [1.0, 2.0, None, 9.0, 9.5, 1.0, 0.0, 12.0, 3.0, 4.0, 20.0, 1.0]


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("day", "date")
    return {(r["key"], r["date"]): (pytest.approx(r["path"]), bool(r["changed"])) for r in learn.page_hinkley(df, ["key"], "value", 0.1, 5.0).collect()}


def test_rejections_and_restarts_equal_one_batch(spark, tmp_path):
    rows = [(k, week(i), v) for k in (1, 2) for i, v in enumerate(VALUES)]
    own = lambda a, b: [r for r in rows if week(a) <= r[1] < week(b)]
    before = spark.conf.get(STORE, None)
    late, twice, early, nobody = (1, week(1), 5.0), (1, week(5), 1.0), (2, week(10), 7.0), (None, week(0), 1.0)
    got = feed(spark, tmp_path, [own(0, 3), [*own(3, 7), late, twice, early, nobody], [*own(7, 12), late]])
    taken = {(r["key"], r["day"]): (r["path"], r["changed"]) for r in got if not r["rejected"]}
    assert taken == batch(spark, rows)
    assert sorted((r["key"], r["day"], r["path"]) for r in got if r["rejected"]) == [(1, week(1), None), (1, week(1), None), (1, week(5), None), (2, week(10), None)]
    assert spark.conf.get(STORE, None) == before


def test_initial_state_from_a_batch(spark, tmp_path):
    rows = [(1, week(i), v) for i, v in enumerate(VALUES)]
    expected = batch(spark, rows)
    last = (week(3) - dt.date(1970, 1, 1)).days
    # the state after four rows, of which the last one was a change
    start = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, last)], "key long, n long, mean double, s double, low double, last long")
    assert expected[1, week(3)][1]
    got = feed(spark, tmp_path, [rows[2:8], rows[8:]], start)
    assert {(r["key"], r["day"]): (r["path"], r["changed"]) for r in got if not r["rejected"]} == {k: v for k, v in expected.items() if k[1] >= week(4)}
    assert sorted(r["day"] for r in got if r["rejected"]) == [week(2), week(3)]
