"""Online learning in streams: each key's state is carried from batch to batch.

The change detector keeps five numbers; the conformal band its level and a window of errors; the rule learner its rules,
bounded by their dictionaries, as bytes. The last two take a weekly calendar: a key's row is rejected, and changes nothing, if it
repeats a date, comes before the last one, or skips weeks.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weekloom.operators.learn import Conformal, RuleLearner
from weekloom.sources.scratch import new_folder

OUT = "key long, event_id long, path double, changed boolean, rejected boolean"
STATE = "n double, mean double, s double, low double, last long"


def page_hinkley_stream(rows: DataFrame, delta: float, threshold: float) -> DataFrame:
    """rows (key, event_id, at in microseconds, value) -> (key, event_id, path, changed, rejected).

    Within a batch a key's rows are taken in order of time and id. A row earlier than the key's last one is rejected and changes
    nothing; NULL values leave the path as it is.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, s, low, last = state.get if state.exists else (0.0, 0.0, 0.0, 0.0, -(2**62))
        for pdf in [pd.concat(list(batches)).sort_values(["at", "event_id"])]:
            out = []
            for ident, at, v in zip(pdf["event_id"], pdf["at"], pdf["value"]):
                late = at < last
                hit = False
                if not late:
                    last = int(at)
                    if pd.notna(v):
                        n += 1
                        mean += (v - mean) / n
                        s += v - mean - delta
                        low = min(low, s)
                        hit = s - low > threshold
                out.append((key[0], ident, s - low, hit, late))
                if hit:
                    n, mean, s, low = 0.0, 0.0, 0.0, 0.0
            state.update((n, mean, s, low, last))
            yield pd.DataFrame(out, columns=["key", "event_id", "path", "changed", "rejected"])

    return rows.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_page_hinkley(spark: SparkSession, sf_dir: str, delta: float = 0.5, threshold: float = 200.0) -> DataFrame:
    """The events of each user through the detector; the sink is a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    e = e.select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    out = new_folder(spark, "online")
    page_hinkley_stream(e, delta, threshold).writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{out}/rows")


WEEK = 7


def weekly_stream(rows: DataFrame, columns: Sequence[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], out: Sequence[str]) -> DataFrame:
    """rows (key long, day date, columns) -> (key, day, ``out`` as doubles, rejected), by ``step(model, values)`` on each key's model.

    The model is kept as bytes. Within a batch a key's rows are taken in order of the day; after a row without a gap the next
    must be seven days later. Rejected rows give NULLs.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blob, last = state.get if state.exists else (pickle.dumps(start()), -1)
        model, got = pickle.loads(blob), []  # noqa: S301  our own bytes
        pdf = pd.concat(list(batches)).sort_values(["day", *columns], kind="stable")
        days = pd.to_datetime(pdf["day"]).to_numpy().astype("datetime64[D]").astype(int)
        for day, at, values in zip(pdf["day"], days, pdf[list(columns)].to_numpy(float)):
            bad = last >= 0 and at != last + WEEK
            if not bad:
                last = int(at)
            got.append((key[0], day, *((np.nan,) * len(out) if bad else step(model, tuple(values))), bool(bad)))
        state.update((pickle.dumps(model), last))
        yield pd.DataFrame(got, columns=["key", "day", *out, "rejected"])

    schema = ", ".join(["key long, day date", *(f"`{c}` double" for c in out), "rejected boolean"])
    x = rows.filter("key is not null and day is not null").select("key", "day", *[F.col(c).cast("double").alias(c) for c in columns])
    got = x.groupBy("key").applyInPandasWithState(run, schema, "model binary, last long", "append", GroupStateTimeout.NoTimeout)
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in out})


def conformal_stream(rows: DataFrame, **options) -> DataFrame:
    """rows (key, day, actual, point) -> (key, day, lower, upper, level, rejected): the band as it was before the row's actual."""

    def step(model: Conformal, values: tuple) -> tuple:
        actual, point = values
        lower, upper = model.band(point)
        level = model.level
        model.learn(actual, point)
        return lower, upper, level

    return weekly_stream(rows, ["actual", "point"], lambda: Conformal(**options), step, ["lower", "upper", "level"])


def learner_stream(rows: DataFrame, features: Sequence[str], target: str, **options) -> DataFrame:
    """rows (key, day, features, target) -> (key, day, prediction, rejected): predict, then learn. The target belongs to the row's own day."""
    features = list(features)

    def step(model: RuleLearner, values: tuple) -> tuple:
        x, y = np.array(values[:-1]), values[-1]
        whole = np.isfinite(x).all()
        guess = model.predict(x) if whole else np.nan
        if whole and np.isfinite(y):
            model.learn(x, y)
        return (guess,)

    return weekly_stream(rows, [*features, target], lambda: RuleLearner(len(features), **options), step, ["prediction"])


def settle(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over what is there into a new folder and reads it back."""
    out = new_folder(spark, "online")
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def staged_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows as a file stream. All files make up one micro-batch, as the order of files written side by side is not that of days."""
    out = new_folder(spark, "arrivals")
    rows.write.parquet(f"{out}/rows")
    return spark.readStream.schema(rows.schema).parquet(f"{out}/rows")
