"""Estimates of every trial of a frame stream in tiers: soon after its onset, later, and at the end of its run.

Frames are (sid, t from 0, ts, v, onset, extra ARRAY): runs of ``frames`` frames follow each other. The
design grows with the stream: an intercept and a slow cosine for each run, the ``extra`` nuisance values,
and a column for each trial, its onset spread by the response. A trial's estimate uses the frames up to
its decode frame and the columns of the trials up to it, with a small ridge (a larger one while there are
fewer frames than columns).

No frame is kept: the state is the running cross products, a row for each column with the columns
before it, and a frame changes only the rows of the columns that aren't 0 in it. So an estimate at any
tier solves the sums as they stand, without a refit over frames.

In a stream, frames may be replayed (they change nothing) or come after later ones: a frame is taken in
when all before it are, others wait in the state. Event-time timers, one for each tier of a trial, close
what will not come any more: once the watermark has passed a decode frame, waiting frames up to it are taken
in without those that are missing, and the tier goes out. So any cut into micro-batches gives what
one ordered pass over the arrived frames gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from axonframe.operators.design import double_gamma
from axonframe.sources.series import SERIES, user_series
from axonframe.sources.tables import table

OUT = "sid long, trial long, tier string, onset long, frame long, used long, columns long, beta double"
TRIALS = 1 << 32  # column numbers: extra values, then two for each run from RUNS, then trials
RUNS = 1 << 20


@dataclass(frozen=True)
class Tiers:
    """``delays``: frames from onset to a tier's decode frame, None for the end of the run; ``runs``: how many the session has, if known; ``step_ms``: from frame to frame."""

    frames: int = 40
    response: tuple[float, ...] = tuple(double_gamma(1.5, 16))
    delays: tuple[tuple[str, int | None], ...] = (("fast", 5), ("slow", 20), ("end", None))
    runs: int | None = None
    extra: int = 0
    step_ms: int = 1000
    ridge: float = 1e-8
    scarce: float = 1e-3

    def decode_frame(self, onset: int, delay: int | None) -> int:
        return (onset // self.frames + 1) * self.frames - 1 if delay is None else onset + delay


class Running:
    """Cross products of one series. ``rows`` maps a column to (its product with y, {earlier column: product})."""

    def __init__(self, s: Tiers, rows: MutableMapping[int, tuple[float, dict[int, float]]], at: int = 0, used: int = 0, trials: int = 0, recent: list | None = None, due: list | None = None):
        self.s, self.rows, self.at, self.used, self.trials = s, rows, at, used, trials
        self.recent: list[tuple[int, int]] = recent or []  # (trial, onset) whose response isn't over
        self.due: list[tuple[int, int, int, str]] = due or []  # (decode frame, trial, onset, tier)

    def columns(self, t: int, extra: list[float]) -> list[tuple[int, float]]:
        """The columns that aren't 0 at a frame, in order."""
        s, run, within = self.s, t // self.s.frames, t % self.s.frames
        drift = math.cos(math.pi * (2 * within + 1) / (2 * s.frames))
        own = [(k, x) for k, x in enumerate(extra) if x] + [(RUNS + 2 * run, 1.0), (RUNS + 2 * run + 1, drift)]
        return own + [(TRIALS + j, s.response[t - o]) for j, o in self.recent if s.response[t - o]]

    def take(self, t: int, v: float, onset: bool, extra: list[float]) -> list[tuple[int, int, int, str]]:
        """Takes a frame in; the decode frames of a trial that begins with it."""
        self.recent = [(j, o) for j, o in self.recent if t - o < len(self.s.response)]
        new = []
        if onset:
            self.recent.append((self.trials, t))
            new = [(self.s.decode_frame(t, d), self.trials, t, tier) for tier, d in self.s.delays]
            self.due += new
            self.trials += 1
        active = self.columns(t, extra)
        for k, (b, x) in enumerate(active):
            with_y, before = self.rows.get(b) or (0.0, {})
            for a, z in active[: k + 1]:
                before[a] = before.get(a, 0.0) + x * z
            self.rows[b] = (with_y + x * v, before)
        self.at, self.used = t + 1, self.used + 1
        return new

    def ready(self, frame: int) -> Iterator[tuple]:
        """(trial, tier, onset, frame, used, columns, beta) of all tiers whose decode frame is ``frame`` at most."""
        out, self.due = [x for x in self.due if x[0] <= frame], [x for x in self.due if x[0] > frame]
        for f, trial, onset, tier in sorted(out):
            beta, columns = self.solved(trial)
            yield trial, tier, onset, min(f, frame), self.used, columns, beta

    def solved(self, trial: int) -> tuple[float, int]:
        known = {b: r for b, r in self.rows.items() if b <= TRIALS + trial}
        names = sorted(known)
        at = {b: k for k, b in enumerate(names)}
        a, c = np.zeros((len(names), len(names))), np.zeros(len(names))
        for b, (with_y, before) in known.items():
            c[at[b]] = with_y
            for e, v in before.items():
                a[at[b], at[e]] = a[at[e], at[b]] = v
        seen = len({(b - RUNS) // 2 for b in names if RUNS <= b < TRIALS})
        columns = self.s.extra + 2 * max(self.s.runs or 0, seen) + trial + 1
        if TRIALS + trial not in at or not a.trace():
            return 0.0, columns
        size = (self.s.scarce if self.used < columns else self.s.ridge) * a.trace() / columns
        return float(np.linalg.solve(a + size * np.eye(len(a)), c)[at[TRIALS + trial]]), columns


def batch(frames: DataFrame, s: Tiers = Tiers(), to_end: bool = True) -> DataFrame:
    """One ordered pass over every series; ``to_end``: decode frames after the last frame count as the last.

    Rows stream through sorted tasks, so a series is never gathered; memory holds its cross products.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, now = None, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rows = [out[i] for i in range(len(out))]
            out.clear()
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]), preserve_index=False)

        for b in batches:
            for who, t, v, onset, extra in zip(*(b.column(c).to_pylist() for c in ("sid", "t", "v", "onset", "extra")), strict=True):
                if now is None or who != sid:
                    if now is not None and to_end:
                        out += [(sid, *x) for x in ended(now)]
                    sid, now = who, Running(s, {})
                if t < now.at:
                    continue
                out += [(sid, *x) for x in now.ready(t - 1)]
                now.take(t, v, onset, extra or [])
                out += [(sid, *x) for x in now.ready(t)]
            if out:
                yield flush()
        if now is not None and to_end:
            out += [(sid, *x) for x in ended(now)]
        if out:
            yield flush()

    def ended(now: Running) -> list[tuple]:
        now.due = [(now.at - 1, *x[1:]) for x in now.due]
        return list(now.ready(now.at - 1))

    return frames.select("sid", "t", "v", "onset", "extra").repartition("sid").sortWithinPartitions("sid", "t").mapInArrow(run, OUT)


class Stored(dict):
    """Rows of cross products, read from the state when first asked for and written back at the end."""

    def __init__(self, state):
        super().__init__()
        self.state, self.touched = state, set()

    def get(self, b, default=None):
        if b not in self:
            if not self.state.containsKey((b,)):
                return default
            with_y, names, sums = self.state.getValue((b,))
            super().__setitem__(b, (with_y, dict(zip(names, sums, strict=True))))
        return self[b]

    def __setitem__(self, b, row):
        self.touched.add(b)
        super().__setitem__(b, row)

    def items(self):
        for (b,) in list(self.state.keys()):
            self.get(b)
        return super().items()

    def save(self) -> None:
        for b in self.touched:
            with_y, before = self[b]
            self.state.updateValue((b,), (with_y, list(before), list(before.values())))


class Processor(StatefulProcessor):
    """State of a series: where it stands, its cross products by column, and frames that came before their turn."""

    def __init__(self, s: Tiers):
        self.s = s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "at long, used long, trials long, zero_ms long, recent array<long>, due array<long>, tiers array<string>")
        self.products = handle.getMapState("products", "col long", "with_y double, names array<long>, sums array<double>")
        self.held = handle.getMapState("held", "t long", "v double, onset boolean, extra array<double>")

    def load(self) -> tuple[Running, int]:
        rows = Stored(self.products)
        if not self.place.exists():
            return Running(self.s, rows), -1
        at, used, trials, zero, recent, due, tiers = self.place.get()
        recent = list(zip(recent[::2], recent[1::2], strict=True))
        return Running(self.s, rows, at, used, trials, recent, list(zip(due[::3], due[1::3], due[2::3], tiers, strict=True))), zero

    def save(self, now: Running, zero: int) -> None:
        now.rows.save()
        self.place.update((now.at, now.used, now.trials, zero, [x for r in now.recent for x in r], [x for r in now.due for x in r[:3]], [r[3] for r in now.due]))

    def forward(self, key: tuple, now: Running, zero: int, upto: int | None) -> list[tuple]:
        """Takes in the waiting frames that follow; with ``upto`` those up to that frame in any case, without what is missing between."""
        out = []
        waiting = sorted(t for (t,) in self.held.keys())
        for t in waiting:
            if t < now.at:
                self.held.removeKey((t,))
                continue
            if t > now.at and (upto is None or t > upto):
                break
            out += [(*key, *x) for x in now.ready(t - 1)]
            v, onset, extra = self.held.getValue((t,))
            self.held.removeKey((t,))
            for frame, *_ in now.take(t, v, onset, list(extra or [])):
                self.handle.registerTimer(zero + (frame + 1) * self.s.step_ms)
            out += [(*key, *x) for x in now.ready(t)]
        if upto is not None:
            out += [(*key, *x) for x in now.ready(upto)]
            now.at = max(now.at, upto + 1)
        return out

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, zero = self.load()
        for f in rows:
            for t, ts, v, onset, extra in zip(f["t"], f["ts"], f["v"], f["onset"], f["extra"], strict=True):
                t = int(t)
                if zero < 0:
                    zero = int(pd.Timestamp(ts).timestamp() * 1000) - t * self.s.step_ms
                if t >= now.at and not self.held.containsKey((t,)):
                    self.held.updateValue((t,), (float(v), bool(onset), [float(x) for x in (extra if extra is not None else [])]))
        out = self.forward(key, now, zero, None)
        self.save(now, zero)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, zero = self.load()
        out = self.forward(key, now, zero, (expiredTimerInfo.getExpiryTimeInMs() - zero) // self.s.step_ms - 1)
        out += self.forward(key, now, zero, None)
        self.save(now, zero)
        yield self.frame(out)

    def close(self) -> None:
        pass


def stream(frames: DataFrame, s: Tiers = Tiers(), late: str = "30 seconds") -> DataFrame:
    """The tiers of streaming frames (sid, t, ts, v, onset, extra). Needs the RocksDB state store, as all state with timers does."""
    marked = frames.withWatermark("ts", late)
    return marked.groupBy("sid").transformWithStateInPandas(Processor(s), OUT, "append", "EventTime")


def user_frames(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user as frames; purchases are trials."""
    rows = user_series(table(spark, d, "events"))
    return rows.select("sid", (F.col("t") - 1).alias("t"), "v", (F.col("event_type") == "purchase").alias("onset"), F.array().cast("array<double>").alias("extra"))


def trial_tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = batch(user_frames(spark, d))
    return rows.select("sid", "trial", "tier", "onset", "frame", "used", "columns", (F.round("beta", 3) + 0.0).alias("beta"))


_H = ", ".join(f"({k}, {x!r}::DOUBLE)" for k, x in enumerate(Tiers().response) if x)
_SWEEP = "CASE WHEN i - 1 = p AND j - 1 = p THEN -1 / m[p + 1][p + 1] WHEN i - 1 = p OR j - 1 = p THEN v / m[p + 1][p + 1] ELSE v - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1] END"
QUERIES = {"trial_tiers": trial_tiers}
ORACLES = {
    "trial_tiers": f"""WITH RECURSIVE {SERIES}, fr AS (SELECT sid, t - 1 AS t, v, event_type = 'purchase' AS onset FROM s), h AS (SELECT * FROM (VALUES {_H}) v(lag, h)),
    o AS (SELECT sid, t AS onset, row_number() OVER (PARTITION BY sid ORDER BY t) - 1 AS trial FROM fr WHERE onset), e AS (SELECT sid, max(t) AS final FROM fr GROUP BY sid),
    d AS (SELECT sid, trial, onset, tier, least(final, CASE tier WHEN 'fast' THEN onset + 5 WHEN 'slow' THEN onset + 20 ELSE (onset // 40 + 1) * 40 - 1 END) AS frame FROM o JOIN e USING (sid), (VALUES ('fast'), ('slow'), ('end')) x(tier)),
    k AS (SELECT *, frame + 1 AS used, 2 * (frame // 40 + 1) AS nuisance, 2 * (frame // 40 + 1) + trial + 1 AS columns FROM d),
    x AS (SELECT sid, t, 2 * (t // 40) AS c, FALSE AS is_trial, 1.0::DOUBLE AS x FROM fr UNION ALL SELECT sid, t, 2 * (t // 40) + 1, FALSE, cos(pi() * (2 * (t % 40) + 1) / 80) FROM fr
        UNION ALL SELECT o.sid, onset + lag, trial, TRUE, h FROM o, h JOIN e ON e.sid = o.sid WHERE onset + lag <= final),
    q AS (SELECT a.sid, a.t, a.c AS a, a.is_trial AS ai, a.x * b.x AS p, b.c AS b, b.is_trial AS bi FROM x a JOIN x b ON a.sid = b.sid AND a.t = b.t UNION ALL SELECT x.sid, x.t, x.c, x.is_trial, x.x * fr.v, -1, NULL FROM x JOIN fr USING (sid, t)),
    g AS (SELECT k.sid, trial, tier, CASE WHEN ai THEN nuisance + a ELSE a END AS i, CASE WHEN b = -1 THEN columns WHEN bi THEN nuisance + b ELSE b END AS j, sum(p) AS v FROM k JOIN q ON q.sid = k.sid AND q.t <= k.frame AND (NOT ai OR a <= trial) AND (bi IS NOT TRUE OR b <= trial) GROUP BY ALL),
    tr AS (SELECT sid, trial, tier, sum(v) AS trace FROM g WHERE i = j GROUP BY ALL),
    f AS (SELECT k.*, (CASE WHEN used < columns THEN 1e-3 ELSE 1e-8 END) * trace / columns AS ridge FROM k JOIN tr USING (sid, trial, tier)),
    cell AS (SELECT f.sid, f.trial, f.tier, i, j, CASE WHEN i = j AND i < columns THEN ridge ELSE 0 END AS r, columns FROM f, unnest(range(0, columns + 1)) a(i), unnest(range(0, columns + 1)) b(j)),
    line AS (SELECT cell.sid, cell.trial, cell.tier, i, list(coalesce(g.v, g2.v, 0) + r ORDER BY j) AS line FROM cell LEFT JOIN g USING (sid, trial, tier, i, j) LEFT JOIN g g2 ON g2.sid = cell.sid AND g2.trial = cell.trial AND g2.tier = cell.tier AND g2.i = cell.j AND g2.j = cell.i GROUP BY ALL),
    mat AS (SELECT sid, trial, tier, list(line ORDER BY i) AS m FROM line GROUP BY ALL),
    sw AS (SELECT sid, trial, tier, m, 0 AS p, columns FROM mat JOIN k USING (sid, trial, tier) UNION ALL
        SELECT sid, trial, tier, list_transform(m, lambda line_, i: list_transform(line_, lambda v, j: {_SWEEP})), p + 1, columns FROM sw WHERE p < columns)
    SELECT f.sid, f.trial, f.tier, f.onset, f.frame, f.used, f.columns, round(m[f.columns][f.columns + 1], 3) + 0.0 AS beta FROM sw JOIN f USING (sid, trial, tier) WHERE p = f.columns""",
}
