"""Single-trial decoding of a frame stream: once a trial's window has passed, its response is estimated on all frames so far.

Frames are (run, t, v, onset BOOLEAN), t counting from 1. A frame lets one trial out at most: the
latest that is ready and hasn't been out, so a backlog leaves last in, first out. The design has the
trial's own response, that of all other trials seen, an intercept and a slow drift; noise is AR(1). The
state is the run's frames, which a run bounds; replayed frames change nothing. Frames are fitted only when
a trial leaves, as the slow drift and the noise of all frames so far change with every frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from axonframe.functions.kernels import ar1_posterior
from axonframe.operators.dense import map_rows, packed
from axonframe.operators.design import double_gamma
from axonframe.sources.series import user_series
from axonframe.sources.tables import table

OUT = "run long, t long, trial long, frames long, mean double, var double, snr double"


@dataclass(frozen=True)
class Decoder:
    """``wait``: frames from onset to readiness. A prior on the response, if given, is combined by precision."""

    wait: int = 5
    least: int = 8
    tr: float = 1.5
    taps: int = 12
    prior: tuple[float, float] | None = None

    def design(self, n: int, onsets: list[int], trial: int) -> np.ndarray:
        h = double_gamma(self.tr, self.taps)
        x = np.zeros((n, 4))
        x[:, 2], x[:, 3] = 1, np.cos(2 * np.pi * np.arange(n) / n)
        for o in set(onsets):
            m = min(self.taps, n - (o - 1))
            x[o - 1 : o - 1 + m, 0 if o == trial else 1] += h[:m]
        return x

    def step(self, v: list[float], onsets: list[int], out: list[int]) -> tuple | None:
        """(trial, frames, mean, var, snr) if the newest frame lets a trial out."""
        n = len(v)
        if n < self.least or len(out) == len(onsets):
            return None
        gone = set(out)
        newest = next((o for o in reversed(onsets) if o + self.wait <= n and o not in gone), None)
        if newest is None:
            return None
        beta, var, _ = ar1_posterior(self.design(n, onsets, newest), np.array(v))
        mean, s = float(beta[0]), float(var[0])
        if self.prior:
            p = 1 / s + 1 / self.prior[1]
            mean, s = (mean / s + self.prior[0] / self.prior[1]) / p, 1 / p
        return newest, n, mean, s, abs(mean) / max(s, 1e-30) ** 0.5

    def run(self, v, onset) -> Iterator[tuple[int, tuple]]:
        seen: list[float] = []
        onsets: list[int] = []
        out: list[int] = []
        for t, (x, starts) in enumerate(zip(v, onset, strict=True), 1):
            seen.append(x)
            if starts:
                onsets.append(t)
            if got := self.step(seen, onsets, out):
                out.append(got[0])
                yield t, got


def decode_batch(frames: DataFrame, decoder: Decoder = Decoder()) -> DataFrame:
    """All trials that leave, run by run."""

    def fit(run, v, onset):
        return [(run, t, *got) for t, got in decoder.run(v, onset)]

    return map_rows(packed(frames, ["run"], F.col("t"), v=F.col("v"), onset=F.col("onset")), fit, OUT)


def decode_stream(frames: DataFrame, decoder: Decoder = Decoder()) -> DataFrame:
    """The same over a stream whose frames of a run arrive in order, cut into any micro-batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v, onsets, out = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows = []
        for r in pd.concat(list(batches)).sort_values("t").itertuples():
            if r.t != len(v) + 1:  # replayed, or after a gap that the source has to fill
                continue
            v.append(float(r.v))
            if r.onset:
                onsets.append(int(r.t))
            if got := decoder.step(v, onsets, out):
                out.append(got[0])
                rows.append((key[0], int(r.t), *got))
        state.update((v, onsets, out))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return frames.groupBy("run").applyInPandasWithState(update, OUT, "v array<double>, onsets array<bigint>, out array<bigint>", "append", GroupStateTimeout.NoTimeout)


def event_frames(spark: SparkSession, d: str) -> DataFrame:
    return user_series(table(spark, d, "events")).select(F.col("sid").alias("run"), "t", "v", (F.col("event_type") == "purchase").alias("onset"))


def lss_decode(spark: SparkSession, d: str) -> DataFrame:
    return decode_batch(event_frames(spark, d))


QUERIES = {"lss_decode": lss_decode}
ORACLES: dict[str, str] = {}
