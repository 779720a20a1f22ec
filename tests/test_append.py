"""A ledger sink under replays and with old heads."""
import hashlib

import pytest
from pyspark.sql import functions as F

from weekloom.operators import ledger
from weekloom.streaming.append import append_batch, append_stream, committed_records

SCHEMA = "user long, id long, event string"


def put(spark, path, batch, rows):
    return append_batch(spark.createDataFrame(rows, SCHEMA), batch, str(path), "user", "id", ["event"])


def chain(events):
    out, before = [], ""
    for e in events:
        out.append(hashlib.sha256(f"{e or ''}|{before}".encode()).hexdigest())
        before = out[-1]
    return out


def test_replays_add_nothing_and_old_heads_are_refused(spark, tmp_path):
    first = [(1, 2, "b"), (1, 1, "a"), (2, 1, None), (None, 1, "x")]
    assert put(spark, tmp_path, 0, first) and put(spark, tmp_path, 2, [(1, 3, "c"), (3, 1, "z")])
    assert not put(spark, tmp_path, 0, first) and not put(spark, tmp_path, 2, [(1, 3, "c")])
    with pytest.raises(ValueError, match="old heads"):
        put(spark, tmp_path, 1, [(1, 9, "late")])
    # a crash after the records and before the commit: the batch is not seen, and is written anew
    spark.createDataFrame([(1, 9, "y", "h", "i", 9)], "user long, id long, event string, previous_hash string, record_hash string, sequence long").write.parquet(f"{tmp_path}/records/batch=3")
    assert committed_records(spark, str(tmp_path)).count() == 5
    assert put(spark, tmp_path, 3, [(1, 4, "d")])
    got = committed_records(spark, str(tmp_path)).orderBy("user", "sequence").collect()
    assert [(r["user"], r["sequence"], r["record_hash"]) for r in got] == [*((1, i + 1, h) for i, h in enumerate(chain("abcd"))), (2, 1, chain([None])[0]), (3, 1, chain("z")[0])]
    bad = ledger.verify_ledger(committed_records(spark, str(tmp_path)), ["user"], "sequence", ["event", "previous_hash"])
    assert bad.agg(F.sum("records"), F.sum("bad_hash"), F.sum("bad_link"), F.sum("bad_sequence")).first()[:] == (6, 0, 0, 0)


def test_stream_with_a_restart(spark, tmp_path):
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        append_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), str(tmp_path / "out"), "user", "id", ["event"])
    got = committed_records(spark, str(tmp_path / "out")).filter("user = 1").orderBy("sequence").collect()
    assert [r["record_hash"] for r in got] == chain("ac")
    with pytest.raises(ValueError, match="no batch"):
        committed_records(spark, str(tmp_path / "none"))
