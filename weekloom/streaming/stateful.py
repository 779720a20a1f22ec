"""Detectors on streams with named state (``transformWithState``): a restart goes on from each key's own variables.

A weekly series may take a row only if it is seven days after the last one taken: repeated, late and early weeks are rejected, row by
row, whatever micro-batch they arrive in. State is kept by key in the state store as plain columns (counts, means, the last
day), not as a blob, and can be handed over from a batch run as initial state.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WEEK = 7
STORE = "spark.sql.streaming.stateStore.providerClass"
STATE = "n long, mean double, s double, low double, last long"
OUT = "key long, day date, path double, changed boolean, rejected boolean"


class PageHinkley(StatefulProcessor):
    """Cumulated rise over the running mean less its minimum; reset after a change. One value state a key, and a list of the days
    on which it changed."""

    def __init__(self, delta: float, threshold: float):
        self.delta, self.threshold = delta, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", STATE)
        self.changes = handle.getListState("changes", "day long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[0]
        self.sums.update((int(r["n"]), float(r["mean"]), float(r["s"]), float(r["low"]), int(r["last"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, mean, s, low, last = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0, 0.0, -1)
        pdf = pd.concat(list(rows)).sort_values(["day", "value"], kind="stable")
        days = pd.to_datetime(pdf["day"]).to_numpy().astype("datetime64[D]").astype(int)
        got = []
        for day, at, value in zip(pdf["day"], days, pdf["value"].to_numpy(float), strict=True):
            if last >= 0 and at != last + WEEK:
                got.append((key[0], day, None, None, True))
                continue
            last = int(at)
            if value == value:
                n += 1
                mean += (value - mean) / n
                s += value - mean - self.delta
                low = min(low, s)
            path = s - low
            got.append((key[0], day, path, path > self.threshold, False))
            if path > self.threshold:
                self.changes.appendValue((last,))
                n, mean, s, low = 0, 0.0, 0.0, 0.0
        self.sums.update((n, mean, s, low, last))
        yield pd.DataFrame(got, columns=["key", "day", "path", "changed", "rejected"])

    def close(self) -> None:
        pass


@contextmanager
def named_state(spark: SparkSession):
    """Named state needs the RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def detector_stream(rows: DataFrame, delta: float, threshold: float, initial: DataFrame | None = None) -> DataFrame:
    """rows (key long, day date, value double) -> (key, day, path, changed, rejected). NULL values are skipped, NULL keys and days left out.

    ``initial`` has one row a key (key, n, mean, s, low, last: days since 1970), the state of a run before.
    """
    own = rows.filter("key is not null and day is not null").select("key", "day", F.col("value").cast("double").alias("value"))
    start = None if initial is None else initial.groupBy("key")
    return own.groupBy("key").transformWithStateInPandas(PageHinkley(delta, threshold), OUT, "Append", "None", start)


def run_arrivals(stream: DataFrame, out: str) -> None:
    """Takes what has arrived, from the checkpoint in ``out`` on, and adds it to the rows there."""
    with named_state(stream.sparkSession):
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
