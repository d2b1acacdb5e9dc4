"""Recursive estimates with small fixed state: diagonal covariances, and AR(1) noise with a running rho; as streams and as ordered batch folds.

A fold reads a series in order of time and holds its state only, so a series may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from axonframe.sources.series import SERIES, user_series
from axonframe.sources.tables import table

State = tuple[float, ...]
Step = Callable[[State, float, float], State]

#: Prior variance, and shape and scale of the noise.
PRIOR, A0, B0 = 1000.0, 0.01, 0.01
DIAGONAL = "m0 double, m1 double, v0 double, v1 double, a double, b double"
AR1 = "m0 double, m1 double, c00 double, c01 double, c11 double, a double, b double, py double, p0 double, p1 double, num double, den double"
START = {DIAGONAL: (0.0, 0.0, PRIOR, PRIOR, A0, B0), AR1: (0.0, 0.0, PRIOR, 0.0, PRIOR, A0, B0, 0.0, 0.0, 0.0, 0.0, 0.0)}
OUT = "sid long, t long, level double, slope double, spread double, rho double"


def diagonal_step(state: State, t: float, y: float) -> State:
    """One frame with the row (1, t / 10): each coefficient by its own variance."""
    m0, m1, v0, v1, a, b = state
    x = t / 10
    s = 1 + v0 + v1 * x * x
    off = y - m0 - m1 * x
    return m0 + v0 * off / s, m1 + v1 * x * off / s, v0 * (1 - v0 / s), v1 * (1 - v1 * x * x / s), a + 0.5, b + 0.5 * off * off / s


def ar1_step(state: State, t: float, y: float) -> State:
    """One frame less rho times the last, where rho is the running lag-1 product of residuals; both residuals are taken with the new estimate."""
    m0, m1, c00, c01, c11, a, b, py, p0, p1, num, den = state
    x = t / 10
    rho = max(-0.99, min(0.99, num / max(den, 1e-10)))
    w0, w1, z = 1 - rho * p0, x - rho * p1, y - rho * py
    s0, s1 = c00 * w0 + c01 * w1, c01 * w0 + c11 * w1
    s = 1 + w0 * s0 + w1 * s1
    off = z - w0 * m0 - w1 * m1
    m0, m1 = m0 + s0 * off / s, m1 + s1 * off / s
    now, last = y - m0 - x * m1, py - p0 * m0 - p1 * m1
    return m0, m1, c00 - s0 * s0 / s, c01 - s0 * s1 / s, c11 - s1 * s1 / s, a + 0.5, b + 0.5 * off * off / s, y, 1.0, x, num + last * now, den + last * last


def finished(kind: str, sid: int, t: int, state: State) -> tuple:
    """Level, slope, the slope's posterior variance and rho."""
    a, b = state[-2:] if kind == DIAGONAL else state[5:7]
    spread = (state[3] if kind == DIAGONAL else state[4]) * b / a
    rho = 0.0 if kind == DIAGONAL else max(-0.99, min(0.99, state[-2] / max(state[-1], 1e-10)))
    return sid, t, state[0], state[1], spread, rho


def folded(frames: DataFrame, kind: str, step: Step) -> DataFrame:
    """The last state of each series of frames (sid, t, v), in one ordered pass over each partition."""
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, last, state = None, 0, START[kind]
        for batch in batches:
            done = []
            for s, t, v in zip(*(batch.column(c).to_pylist() for c in ("sid", "t", "v")), strict=True):
                if s != sid:
                    if sid is not None:
                        done.append(finished(kind, sid, last, state))
                    sid, state = s, START[kind]
                state, last = step(state, t, v), t
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done])
        if sid is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, finished(kind, sid, last, state), strict=True))])

    rows = frames.filter("sid IS NOT NULL AND v IS NOT NULL").select("sid", "t", F.col("v").cast("double").alias("v"))
    return rows.repartition("sid").sortWithinPartitions("sid", "t").mapInArrow(run, OUT)


def streamed(frames: DataFrame, kind: str, step: Step) -> DataFrame:
    """The state of each series after every micro-batch that has frames of it; replayed frames change nothing."""
    names = [c.split()[0] for c in OUT.split(", ")]

    def update(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        t, *state = held.get if held.exists else (0, *START[kind])
        rows = pd.concat(list(parts)).sort_values("t")
        for at, v in zip(rows["t"].tolist(), rows["v"].tolist(), strict=True):
            if at > t:
                state, t = step(tuple(state), at, v), at
        held.update((t, *state))
        yield pd.DataFrame([finished(kind, key[0], t, tuple(state))], columns=names)

    return frames.groupBy("sid").applyInPandasWithState(update, OUT, f"t long, {kind}", "update", GroupStateTimeout.NoTimeout)


def _final(spark: SparkSession, d: str, kind: str, step: Step) -> DataFrame:
    got = folded(user_series(table(spark, d, "events")).select("sid", "t", "v"), kind, step)
    return got.select("sid", "t", *(F.round(c, 5).alias(c) for c in ("level", "slope", "spread", "rho")))


def kalman_diagonal(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d, DIAGONAL, diagonal_step)


def kalman_ar1(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d, AR1, ar1_step)


QUERIES = {f.__name__: f for f in (kalman_diagonal, kalman_ar1)}
_LAST = "row_number() OVER (PARTITION BY sid ORDER BY t DESC) = 1"
ORACLES = {
    "kalman_diagonal": f"""WITH RECURSIVE {SERIES}, x AS (SELECT sid, t, v AS y, t / 10 AS x FROM s),
        r AS (SELECT DISTINCT sid, 0::BIGINT AS t, 0.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, 1000.0::DOUBLE AS v0, 1000.0::DOUBLE AS v1, 0.01::DOUBLE AS a, 0.01::DOUBLE AS b FROM s
        UNION ALL SELECT sid, t, m0 + v0 * o / d, m1 + v1 * x * o / d, v0 * (1 - v0 / d), v1 * (1 - v1 * x * x / d), a + 0.5, b + 0.5 * o * o / d
            FROM (SELECT r.* EXCLUDE (t), x.t, x.x, 1 + v0 + v1 * x * x AS d, y - m0 - m1 * x AS o FROM r JOIN x ON x.sid = r.sid AND x.t = r.t + 1))
        SELECT sid, t, round(m0, 5) AS level, round(m1, 5) AS slope, round(v1 * b / a, 5) AS spread, 0.0::DOUBLE AS rho FROM r QUALIFY {_LAST}""",
    "kalman_ar1": f"""WITH RECURSIVE {SERIES}, x AS (SELECT sid, t, v AS y, t / 10 AS x FROM s),
        r AS (SELECT DISTINCT sid, 0::BIGINT AS t, {', '.join(f'{v!r}::DOUBLE AS {c.split()[0]}' for c, v in zip(AR1.split(', '), START[AR1], strict=True))} FROM s
        UNION ALL SELECT sid, t, n0, n1, c00 - s0 * s0 / d, c01 - s0 * s1 / d, c11 - s1 * s1 / d, a + 0.5, b + 0.5 * o * o / d, y, 1.0, x, num + (py - p0 * n0 - p1 * n1) * (y - n0 - x * n1), den + (py - p0 * n0 - p1 * n1) ** 2
            FROM (SELECT *, m0 + s0 * o / d AS n0, m1 + s1 * o / d AS n1 FROM (SELECT *, 1 + w0 * s0 + w1 * s1 AS d, z - w0 * m0 - w1 * m1 AS o FROM (SELECT *, c00 * w0 + c01 * w1 AS s0, c01 * w0 + c11 * w1 AS s1
            FROM (SELECT *, 1 - rho * p0 AS w0, x - rho * p1 AS w1, y - rho * py AS z FROM (SELECT r.* EXCLUDE (t), x.t, x.x, x.y, greatest(-0.99, least(0.99, num / greatest(den, 1e-10))) AS rho FROM r JOIN x ON x.sid = r.sid AND x.t = r.t + 1))))))
        SELECT sid, t, round(m0, 5) AS level, round(m1, 5) AS slope, round(c11 * b / a, 5) AS spread, round(greatest(-0.99, least(0.99, num / greatest(den, 1e-10))), 5) AS rho FROM r QUALIFY {_LAST}""",
}
