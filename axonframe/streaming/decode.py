"""Stateful decoding of frame streams, with batch twins that must agree.

State per series is small and fixed: a mean, a covariance and two scalars for recursive least squares,
or the last ``width`` rows for sliding connectivity. Micro-batches may cut a series anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from axonframe.functions.kernels import rls, rls_step
from axonframe.operators.dense import map_rows, packed
from axonframe.plans.session import shared_folder
from axonframe.sources.series import SERIES, user_series
from axonframe.sources.tables import table

STATE = "t long, mean array<double>, cov array<double>, a double, b double"
OUT = "sid long, t long, level double, slope double, sigma2 double"


def row_of(t: float) -> np.ndarray:
    """Intercept and a slow trend."""
    return np.array([1.0, t / 10])


def result(sid: int, t: int, state: tuple[np.ndarray, np.ndarray, float, float]) -> tuple:
    mean, _, a, b = state
    return sid, t, float(mean[0]), float(mean[1]), max(b / (a - 1), 1e-10) if a > 1 else float(b)


def rls_update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    t, mean, cov, a, b = state.get if state.exists else (0, [0.0, 0.0], [1e3, 0.0, 0.0, 1e3], 0.01, 0.01)
    now = (np.array(mean), np.array(cov).reshape(2, 2), a, b)
    rows = pd.concat(list(frames)).sort_values("t")
    for at, v in zip(rows["t"], rows["v"], strict=True):
        if at > t:  # a replayed frame changes nothing
            now, t = rls_step(now, row_of(at), v), int(at)
    state.update((t, now[0].tolist(), now[1].ravel().tolist(), now[2], now[3]))
    yield pd.DataFrame([result(key[0], t, now)], columns=["sid", "t", "level", "slope", "sigma2"])


def rls_stream(frames: DataFrame) -> DataFrame:
    """Frames (sid, t, v), bounded or streaming in order of t per series, to the posterior after each micro-batch."""
    return frames.groupBy("sid").applyInPandasWithState(rls_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def rls_batch(frames: DataFrame) -> DataFrame:
    def fit(sid, t, v):
        return [result(sid, int(t[-1]), rls(np.array([row_of(x) for x in t]), v))]

    return map_rows(packed(frames, ["sid"], F.col("t"), t=F.col("t"), v=F.col("v")), fit, OUT)


def ring_update(width: int):
    """The last ``width`` values of a pair of channels; the scaled correlation once the ring is full."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, x, y = state.get if state.exists else (0, [], [])
        x, y, out = list(x), list(y), []
        for r in pd.concat(list(frames)).sort_values("t").itertuples():
            if r.t > t:
                t, x, y = int(r.t), [*x, r.x][-width:], [*y, r.y][-width:]
                if len(x) == width:
                    a, b = np.array(x) - np.mean(x), np.array(y) - np.mean(y)
                    out.append((*key, t, float((a * b).mean() / ((a.std() * b.std()) or np.inf) * width / (width - 1))))
        state.update((t, x, y))
        yield pd.DataFrame(out, columns=["ch_i", "ch_j", "t", "r"])

    return update


def ring_stream(pairs: DataFrame, width: int) -> DataFrame:
    """(ch_i, ch_j, t, r) of streaming pairs (ch_i, ch_j, t, x, y)."""
    return pairs.groupBy("ch_i", "ch_j").applyInPandasWithState(ring_update(width), "ch_i string, ch_j string, t long, r double", "t long, x array<double>, y array<double>", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Tumbling event-time windows with a watermark; NTZ times are read as UTC."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_end(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Drains an available-now stream into a memory table; for tests and small replays."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}").start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def frames_schema() -> T.StructType:
    return T.StructType([T.StructField("sid", T.LongType()), T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())])


def rls_final(spark: SparkSession, d: str) -> DataFrame:
    """Batch twin over whole series: level and slope after the last frame."""
    frames = user_series(table(spark, d, "events")).select("sid", "t", "v")
    return rls_batch(frames).select("sid", "t", F.round("level", 4).alias("level"), F.round("slope", 4).alias("slope"))


def event_time_windows(spark: SparkSession, d: str) -> DataFrame:
    w = event_windows(table(spark, d, "events"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (rls_final, event_time_windows)}
_RLS = f"""WITH {SERIES}, m AS (SELECT sid, max(t) AS t, count(*) + 1e-3 AS a, sum(t / 10) AS b, sum((t / 10) ** 2) + 1e-3 AS c, sum(v) AS p, sum(v * t / 10) AS q FROM s GROUP BY 1)
    SELECT sid, t, round((c * p - b * q) / (a * c - b * b), 4) AS level, round((a * q - b * p) / (a * c - b * b), 4) AS slope FROM m"""
ORACLES = {"rls_final": _RLS, "event_time_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
