"""Frame by frame: projection, parcels, a sliding window and what is computed on it, as one streaming query of several stateful steps.

Frames come in long form, (sid, t, ts, node, v). Node values are weighed into parcels by a static table, an
aggregate that closes a frame once the watermark has passed it; a second one gathers the parcels of a
frame; a stateful step keeps the last ``width`` frames of each ``sid`` and their sums. The watermark goes
through all of them. The state is bounded: a window of frames, and its Gram matrix, to which a new frame adds
and from which the oldest is taken.

Two things are computed on a full window: correlations of parcels with their modularity, and the low-rank part
of the newest frame, by the Gram matrix of the window's frames (frames by frames, so the number of parcels doesn't matter).
A replayed frame changes nothing. The batch twins run the same steps over sorted tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from axonframe.functions.kernels import fix_signs, noise_threshold
from axonframe.sources.series import DAILY, daily_channels
from axonframe.sources.tables import table

STATE = "t long, width int, re array<double>, im array<double>, gram_re array<double>, gram_im array<double>"


class Window:
    """The last ``width`` frames as complex vectors, and their products with each other."""

    def __init__(self, width: int, t: int = -(1 << 62), frames: np.ndarray | None = None, gram: np.ndarray | None = None):
        self.width, self.t, self.frames, self.gram = width, t, frames, gram

    def add(self, t: int, v: np.ndarray) -> bool:
        """Takes a frame in; False if it or a later one has been here."""
        if t <= self.t:
            return False
        old = np.zeros((0, len(v)), complex) if self.frames is None else self.frames[-(self.width - 1) :]
        kept = np.zeros((0, 0), complex) if self.gram is None else self.gram[-(self.width - 1) :, -(self.width - 1) :]
        cross = old.conj() @ v
        self.gram = np.block([[kept, cross[:, None]], [cross.conj()[None, :], np.array([[np.vdot(v, v)]])]])
        self.frames, self.t = np.vstack([old, v]), t
        return True

    @property
    def full(self) -> bool:
        return len(self.frames) == self.width


@dataclass(frozen=True)
class Connectivity:
    """(sid, t, q, r): correlations (upper triangle by rows, scaled by width / (width - 1)) and the modularity of their positive part for soft groups from ``groups`` leading eigenvectors."""

    width: int = 10
    groups: int = 5
    schema: str = "sid long, t long, q double, r array<double>"

    def of(self, sid: int, w: Window) -> Iterator[tuple]:
        if not w.full:
            return
        x = w.frames.real
        spread = x.std(0)
        z = (x - x.mean(0)) / np.where(spread == 0, 1, spread)
        r = z.T @ z / (self.width - 1)
        yield sid, w.t, self.modularity(np.maximum(r, 0) * (1 - np.eye(len(r)))), r[np.triu_indices(len(r), 1)].tolist()

    def modularity(self, a: np.ndarray) -> float:
        e = np.exp(fix_signs(np.linalg.eigh(a)[1][:, -min(self.groups, len(a)) :]))
        c, k, total = e / e.sum(1, keepdims=True), a.sum(1), a.sum() or 1.0
        b = (a - np.outer(k, k) / total) * (1 - np.eye(len(a)))
        return float(np.trace(c.T @ b @ c) / total)


@dataclass(frozen=True)
class LowRank:
    """(sid, t, kept, re, im): the newest frame without what lies under the noise level of its window. Windows of two frames and more count."""

    width: int = 30
    sigma: float | None = None
    schema: str = "sid long, t long, kept long, re array<double>, im array<double>"

    def of(self, sid: int, w: Window) -> Iterator[tuple]:
        n, p = w.frames.shape
        if n < 2:
            return
        sigma = self.sigma
        if sigma is None:
            d = np.diff(w.frames.real, axis=0)
            sigma = float(np.median(np.abs(d - np.median(d)))) / 0.6745
        s2, u = np.linalg.eigh(w.gram.conj())
        keep = np.sqrt(np.maximum(s2, 0)) > noise_threshold(p, n, sigma)
        last = (u[:, keep] @ u[-1, keep].conj()).conj() @ w.frames if keep.any() else np.zeros(p, complex)
        yield sid, w.t, int(keep.sum()), last.real.tolist(), last.imag.tolist()


def complex_of(re, im) -> np.ndarray:
    return np.asarray(re, float) + 1j * (np.asarray(im, float) if im is not None and len(im) else 0.0)


class Processor(StatefulProcessor):
    def __init__(self, measure: Connectivity | LowRank):
        self.measure = measure

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        w = Window(self.measure.width)
        if self.window.exists():
            t, n, re, im, gre, gim = self.window.get()
            w = Window(self.measure.width, t, complex_of(re, im).reshape(n, -1), complex_of(gre, gim).reshape(n, n))
        out = []
        batch = pd.concat(list(rows)).sort_values("t")
        for t, re, im in zip(batch["t"], batch["re"], batch["im"], strict=True):
            if w.add(int(t), complex_of(re, im)):
                out += self.measure.of(key[0], w)
        f, g = w.frames, w.gram
        self.window.update((w.t, len(f), f.real.ravel().tolist(), f.imag.ravel().tolist(), g.real.ravel().tolist(), g.imag.ravel().tolist()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.measure.schema.split(", ")])

    def close(self) -> None:
        pass


def streamed(vectors: DataFrame, measure: Connectivity | LowRank) -> DataFrame:
    """The measure of each frame of streaming (sid, t, re, im ARRAY), frames of a sid in order. Needs the RocksDB state store."""
    return vectors.groupBy("sid").transformWithStateInPandas(Processor(measure), measure.schema, "append", "None")


def batch(vectors: DataFrame, measure: Connectivity | LowRank) -> DataFrame:
    """The same over sorted tasks; memory holds a window."""
    names = [c.split()[0] for c in measure.schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sid, w = None, None
        for b in batches:
            out = []
            for who, t, re, im in zip(b["sid"], b["t"], b["re"], b["im"], strict=True):
                if w is None or who != sid:
                    sid, w = who, Window(measure.width)
                if w.add(int(t), complex_of(re, im)):
                    out += measure.of(int(sid), w)
            yield pd.DataFrame(out, columns=names)

    return vectors.select("sid", "t", "re", "im").repartition("sid").sortWithinPartitions("sid", "t").mapInPandas(run, measure.schema)


def parcels(frames: DataFrame, weights: DataFrame, late: str = "10 seconds", tick: str = "1 second") -> DataFrame:
    """(sid, t, re, im): the parcels of each frame, in order, from (sid, t, ts, node, v) and static weights (node, parcel, w)."""
    node = frames.withWatermark("ts", late).join(weights, "node")
    summed = node.groupBy(F.window("ts", tick), "sid", "t", "parcel").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    whole = summed.groupBy(F.window(F.window_time("window"), tick), "sid", "t").agg(F.array_sort(F.collect_list(F.struct("parcel", "v"))).alias("x"))
    return whole.select("sid", "t", F.transform("x", lambda p: p["v"]).alias("re"), F.array().cast("array<double>").alias("im"))


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Weights (node, parcel, w) of two static projections (node, vertex, w) and (vertex, parcel, w), one after the other."""
    both = first.select("node", "vertex", F.col("w").alias("w1")).join(second.select("vertex", "parcel", F.col("w").alias("w2")), "vertex")
    return both.groupBy("node", "parcel").agg(F.sum(F.col("w1") * F.col("w2")).alias("w"))


def chain(frames: DataFrame, weights: DataFrame, measure: Connectivity | LowRank, how: Callable[[DataFrame, Connectivity | LowRank], DataFrame] = streamed) -> DataFrame:
    """Projection, parcels, window and measure in one query."""
    return how(parcels(frames, weights), measure)


def _day_frames(spark: SparkSession, d: str) -> DataFrame:
    days = daily_channels(table(spark, d, "events"))
    return days.select(F.lit(1).cast("long").alias("sid"), F.col("tr").alias("t"), F.timestamp_seconds(F.col("tr") * 60).alias("ts"), F.col("ch").alias("node"), "v")


def _weights(frames: DataFrame) -> DataFrame:
    p = F.explode(F.sequence(F.lit(0), F.lit(3)))
    return frames.select("node").distinct().select("node", p.alias("parcel")).withColumn("w", 1 / (1 + F.abs(F.length("node") - 6 - F.col("parcel"))))


def frame_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of four parcels of the channels over ten days, day by day."""
    f = _day_frames(spark, d)
    rows = chain(f, _weights(f), Connectivity(10, 3), batch).select("t", F.posexplode("r").alias("pair", "r"))
    return rows.select("t", "pair", F.round("r", 6).alias("r"))


def frame_modularity(spark: SparkSession, d: str) -> DataFrame:
    f = _day_frames(spark, d)
    return chain(f, _weights(f), Connectivity(10, 3), batch).select("t", F.round("q", 6).alias("q"))


QUERIES = {f.__name__: f for f in (frame_connectivity, frame_modularity)}
ORACLES = {
    "frame_connectivity": f"""WITH {DAILY}, p AS (SELECT tr, p.p, sum(v / (1 + abs(length(ch) - 6 - p.p))) AS v FROM long, (VALUES (0), (1), (2), (3)) p(p) GROUP BY 1, 2),
        n AS (SELECT tr, row_number() OVER (ORDER BY tr) AS k FROM (SELECT DISTINCT tr FROM p)), w AS (SELECT b.tr AS t, p.p, p.v, p.tr FROM n a JOIN n b ON a.k BETWEEN b.k - 9 AND b.k JOIN p ON p.tr = a.tr WHERE b.k >= 10)
        SELECT a.t, CAST(row_number() OVER (PARTITION BY a.t ORDER BY a.p, b.p) - 1 AS INT) AS pair, round(coalesce(corr(a.v, b.v), 0) * 10 / 9, 6) AS r FROM w a JOIN w b ON a.t = b.t AND a.tr = b.tr AND a.p < b.p GROUP BY a.t, a.p, b.p""",
}
