"""Dense kernels over packed rows: Spark groups and shuffles, numpy works on one series or matrix at a time.

A group is packed into arrays by an aggregate (so values are ordered and moved once), and kernels run
in Arrow batches of packed rows. One group has to fit a task: that holds for channel matrices, patches
and windows, not for a user's series (``_series``) on skewed data. What can be said in sums and joins is
in ``normal``, ``designs``, ``matrices``, ``components`` and ``spatial`` instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions import kernels as K
from axonframe.operators.designs import column_curve
from axonframe.operators.evaluation import rdm
from axonframe.operators.moments import guarded_corr, pairs
from axonframe.operators.trials import repeats_mean
from axonframe.plans.ranks import ranked
from axonframe.plans.session import cut
from axonframe.sources.series import daily_channels, day_number, trial_features, user_series
from axonframe.sources.tables import table


def packed(rows: DataFrame, keys: list[str], order: Column, **values: Column) -> DataFrame:
    """One row per key with an array per value, all in ``order``."""
    items = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), *(v.alias(n) for n, v in values.items())))).alias("items"))
    return items.select(*keys, *(F.col(f"items.{n}").alias(n) for n in values))


def map_rows(df: DataFrame, kernel: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Calls ``kernel(**row)`` for each packed row; it returns any number of output rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for record in b.to_dict("records") for r in kernel(**{k: np.asarray(v) if isinstance(v, (list, np.ndarray)) else v for k, v in record.items()})]
            yield pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({n: [] for n in names})

    names = [c.strip().split()[0] for c in schema.split(",")]
    return df.mapInPandas(run, schema)


# -- packings of the driver tables -------------------------------------------------------------------


def _series(spark: SparkSession, d: str) -> DataFrame:
    return packed(user_series(table(spark, d, "events")), ["sid"], F.col("t"), y=F.col("v"), e=F.col("event_id").cast("double"))


def _channels(spark: SparkSession, d: str) -> DataFrame:
    """One row: covariance ``c`` and correlation ``r`` of all channel pairs over the days that both have; 0 where they share less than two."""
    long = pairs(daily_channels(table(spark, d, "events")))
    m = long.groupBy("ch_i", "ch_j").agg(F.coalesce(F.covar_samp("x", "y"), F.lit(0.0)).alias("c"), guarded_corr("x", "y").alias("r")).withColumn("one", F.lit(1))
    return packed(m, ["one"], F.struct("ch_i", "ch_j"), i=F.col("ch_i"), j=F.col("ch_j"), c=F.col("c"), r=F.col("r"))


def _matrix(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Values placed by their keys; pairs that aren't there are 0."""
    names = sorted(set(i.tolist()))
    place = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    m[[place[a] for a in i.tolist()], [place[b] for b in j.tolist()]] = v
    return m, names


def _cov(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The covariance matrix; where cells are missing, pairs may contradict, and negative eigenvalues are set to 0."""
    m, names = _matrix(i, j, c)
    w, v = np.linalg.eigh(m)
    return (m if w[0] >= 0 else (v * np.maximum(w, 0)) @ v.T), names


def _square(m: np.ndarray, names: list[str]) -> list[tuple]:
    return [(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]


def _fc(i: np.ndarray, j: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, list[str]]:
    w, names = _matrix(i, j, np.maximum(r, 0))
    np.fill_diagonal(w, 0)
    return w, names


# -- queries -----------------------------------------------------------------------------------------


def fracridge(spark: SparkSession, d: str) -> DataFrame:
    def fit(sid, y, e):
        fr = np.array([0.25, 0.5, 0.75, 1.0])
        return [(sid, float(f), float(np.linalg.norm(b))) for f, b in zip(fr, K.fractional_ridge(K.drift_design(len(y)), y, fr), strict=True)]

    return map_rows(_series(spark, d), fit, "sid long, frac double, norm double")


def fracridge_cv(spark: SparkSession, d: str) -> DataFrame:
    """The fraction that predicts a series' other half best; series of one length share their design and are fitted together."""
    fr = np.linspace(0.05, 1, 20)

    def fit(ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, half = K.drift_design(len(ys)), len(ys) // 2
        folds = [(slice(0, half), slice(half, None)), (slice(half, None), slice(0, half))]
        r2 = np.mean([[1 - ((ys[b] - x[b] @ c) ** 2).sum(0) / (((ys[b] - ys[b].mean(0)) ** 2).sum(0) + 1e-12) for c in K.fractional_ridges(x[a], ys[a], fr)] for a, b in folds], axis=0)
        return fr[r2.argmax(0)], r2.max(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, same in b.groupby(b["y"].map(len)):
                if n >= 12:
                    frac, r2 = fit(np.stack([np.asarray(y, float) for y in same["y"]], axis=1))
                    yield pd.DataFrame({"sid": same["sid"].to_numpy(), "frac": frac, "r2": r2})

    return _series(spark, d).select("sid", "y").mapInPandas(run, "sid long, frac double, r2 double")


def eigenmaps_embed(spark: SparkSession, d: str) -> DataFrame:
    def fit(one, i, j, c, r):
        w, names = _fc(i, j, r)
        _, vec = K.eigenmaps(w, 2)
        return [(n, float(a), float(b)) for n, (a, b) in zip(names, vec, strict=True)]

    return map_rows(_channels(spark, d), fit, "ch string, x double, y double")


def diffusion_map(spark: SparkSession, d: str) -> DataFrame:
    def fit(one, i, j, c, r):
        w, names = _fc(i, j, r)
        _, vec = K.diffusion_map(w, 2)
        return [(n, float(a), float(b)) for n, (a, b) in zip(names, vec, strict=True)]

    return map_rows(_channels(spark, d), fit, "ch string, x double, y double")


def spectral_features(spark: SparkSession, d: str) -> DataFrame:
    def fit(one, i, j, c, r):
        values = np.linalg.eigvalsh(K.graph_laplacian(_fc(i, j, r)[0]))
        return [("gap", float(values[1])), ("connectivity", float(values[1])), ("largest", float(values[-1]))]

    return map_rows(_channels(spark, d), fit, "feature string, value double")


def hilbert_envelope(spark: SparkSession, d: str) -> DataFrame:
    def fit(sid, y, e):
        z = K.analytic(y - y.mean())
        return [(sid, t + 1, float(abs(v)), float(np.angle(v))) for t, v in enumerate(z)]

    return map_rows(_series(spark, d), fit, "sid long, t long, envelope double, phase double")


def band_filter(spark: SparkSession, d: str) -> DataFrame:
    def fit(sid, y, e):
        return [(sid, t + 1, float(v)) for t, v in enumerate(K.zero_phase_filter(y, K.butterworth(len(y), 4, 0.02, 0.2)))]

    return map_rows(_series(spark, d), fit, "sid long, t long, filtered double")


def spectral_fill(spark: SparkSession, d: str) -> DataFrame:
    def fit(sid, y, e):
        return [(sid, t + 1, float(v)) for t, v in enumerate(K.spectral_fill(y, e % 5 != 0))]

    return map_rows(_series(spark, d), fit, "sid long, t long, filled double")


def _rdms(spark: SparkSession, d: str) -> DataFrame:
    """Two image distance matrices, from odd and even trials, side by side."""
    f = trial_features(table(spark, d, "embeddings"))
    halves = [rdm(repeats_mean(f.filter(f"trial % 2 = {r}"))).withColumnRenamed("d", f"d{r}") for r in (0, 1)]
    return packed(halves[0].join(halves[1], ["i", "j"]).withColumn("one", F.lit(1)), ["one"], F.struct("i", "j"), a=F.col("d0"), b=F.col("d1"))


def _full(v: np.ndarray) -> np.ndarray:
    n = int((1 + np.sqrt(1 + 8 * len(v))) / 2)
    m = np.zeros((n, n))
    m[np.triu_indices(n, 1)] = v
    return m + m.T


def sinkhorn(spark: SparkSession, d: str) -> DataFrame:
    def fit(one, a, b):
        x, y = _full(a), _full(b)
        cost = ((x[:, None] - y[None]) ** 2).sum(2)
        return [("wasserstein", float((K.sinkhorn(cost) * cost).sum()))]

    return map_rows(_rdms(spark, d), fit, "measure string, value double")


def gromov_w(spark: SparkSession, d: str) -> DataFrame:
    return map_rows(_rdms(spark, d), lambda one, a, b: [("gromov", K.gromov(_full(a), _full(b)))], "measure string, value double")


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    """A volume from part sizes: 10 x 10 x n, one value per voxel."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 10).cast("int").alias("x"), (F.floor(k / 10) % 10).cast("int").alias("y"), F.floor(k / 100).cast("int").alias("z"), F.col("p_size").cast("double").alias("v"))


def patches(voxels: DataFrame, size: int, stride: int, frames: int) -> DataFrame:
    """Voxels (x, y, z, v), z being time, with every overlapping square of the plane that holds them, named by its corner, and their window of time."""
    corners = lambda c: F.filter(F.sequence(F.floor((F.col(c) - size + stride) / stride), F.floor(F.col(c) / stride)), lambda i: i >= 0)
    out = voxels.withColumn("win", F.floor(F.col("z") / frames))
    for c in "xy":
        out = out.withColumn(f"p{c}", F.explode(corners(c)))
    return out


def nordic_patch(spark: SparkSession, d: str) -> DataFrame:
    """Each overlapping patch is cut to low rank as voxels by time; a voxel is the mean over its patches."""

    def fit(px, py, win, x, y, z, v):
        place = np.unique(x * 10_000 + y, return_inverse=True)[1]
        m = np.zeros((place.max() + 1, z.max() - z.min() + 1))
        m[place, z - z.min()] = v
        cut = K.low_rank(m, float(m.std()) / 4 + 1e-9)[0]
        return [(int(a), int(b), int(c), float(w)) for a, b, c, w in zip(x, y, z, cut[place, z - z.min()], strict=True)]

    p = packed(patches(_voxels(spark, d), 4, 2, 10), ["px", "py", "win"], F.struct("x", "y", "z"), x=F.col("x"), y=F.col("y"), z=F.col("z"), v=F.col("v"))
    return map_rows(p, fit, "x long, y long, z long, v double").groupBy("x", "y", "z").agg(F.avg("v").alias("v"), F.count("*").alias("patches"))


def edge_keeping(voxels: DataFrame, radius: int, space: float, tone: float) -> DataFrame:
    """(x, y, z, v): mean over a cube of neighbours, weighted by distance and by likeness; outside of the mask counts as 0. One equi-join, for volumes of any size."""
    steps = [(i, j, k) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) for k in range(-radius, radius + 1)]
    around = F.array(*(F.struct(*(F.lit(n).alias(f"d{c}") for c, n in zip("xyz", s, strict=True)), F.lit(-sum(n * n for n in s) / (2 * space**2)).alias("near")) for s in steps))
    out = voxels.withColumn("s", F.explode(around)).select(*(F.col(c).alias(f"o{c}") for c in "xyz"), F.col("v").alias("own"), F.col("s.near").alias("near"), *((F.col(c) + F.col(f"s.d{c}")).alias(c) for c in "xyz"))
    v = F.coalesce("v", F.lit(0.0))
    w = out.join(voxels, ["x", "y", "z"], "left").select("ox", "oy", "oz", v.alias("v"), F.exp(F.col("near") - (v - F.col("own")) ** 2 / (2 * tone**2)).alias("w"))
    return w.groupBy(F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("oz").alias("z")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def bilateral(spark: SparkSession, d: str) -> DataFrame:
    return edge_keeping(_voxels(spark, d), 1, 1.5, 5.0).select("x", "y", "z", F.round("v", 6).alias("v"))


def phase_corr(spark: SparkSession, d: str) -> DataFrame:
    """The shift in days that brings each channel onto each other one, over all days that both have."""

    def fit(ch_i, ch_j, x, y):
        return [(ch_i, ch_j, float(K.translation(x, y)[0]))] if len(x) > 2 else []

    both = pairs(daily_channels(table(spark, d, "events"))).filter("ch_i < ch_j")
    return map_rows(packed(both, ["ch_i", "ch_j"], F.col("tr"), x=F.col("x"), y=F.col("y")), fit, "ch_i string, ch_j string, shift double")


def day_products(days: DataFrame, key: str) -> DataFrame:
    """(tr, ts, g): products of all pairs of days, summed over the series (key, tr, v), each less its mean. A series is packed once, and its own days meet in its row."""
    series = days.groupBy(key).agg(F.avg("v").alias("m"), F.collect_list(F.struct("tr", "v")).alias("days"))
    met = series.select("m", "days", F.explode("days").alias("a")).select("m", "a", F.explode("days").alias("b"))
    return met.groupBy(F.col("a.tr").alias("tr"), F.col("b.tr").alias("ts")).agg(F.sum((F.col("a.v") - F.col("m")) * (F.col("b.v") - F.col("m"))).alias("g"))


def acompcor(spark: SparkSession, d: str) -> DataFrame:
    """Components of the noise pool, the most variable series, as a day x user Gram matrix that Spark sums up."""
    pool = tcompcor_pool(spark, d).select(F.col("sid").alias("user_id"))
    e = table(spark, d, "events").select("user_id", day_number().alias("tr"), "value").join(pool, "user_id", "left_semi")
    gram = day_products(cut(e.groupBy("user_id", "tr").agg(F.avg("value").alias("v"))), "user_id").withColumn("one", F.lit(1))

    def fit(one, i, j, g):
        days = np.unique(i)
        m = np.zeros((len(days), len(days)))
        m[np.searchsorted(days, i), np.searchsorted(days, j)] = g
        w, v = np.linalg.eigh(m)
        top = K.fix_signs(v[:, ::-1][:, :3])
        return [(int(t), k, float(top[a, k])) for a, t in enumerate(days) for k in range(top.shape[1])]

    return map_rows(packed(gram, ["one"], F.struct("tr", "ts"), i=F.col("tr"), j=F.col("ts"), g=F.col("g")), fit, "tr long, component long, v double")


def glmdenoise(spark: SparkSession, d: str) -> DataFrame:
    """(components, r2, chosen): mean fit of all users and runs of ten days with 0 to 3 noise components beside a line, and the number that fits best; ties go to the smaller."""
    wide = acompcor(spark, d).groupBy("tr").pivot("component", [0, 1, 2]).agg(F.first("v")).select("tr", *(F.col(str(k)).alias(f"c{k}") for k in range(3)))
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("sid"), day_number().alias("tr")).agg(F.avg("value").alias("y"))
    rows = e.join(wide, "tr").withColumns({"run": F.floor((F.col("tr") - 1) / 10), "one": F.lit(1.0), "line": F.col("tr").cast("double")})
    curve = cut(column_curve(rows, ["sid", "run"], ["one", "line"], ["c0", "c1", "c2"]).groupBy("columns").agg(F.avg("r2").alias("r2")))
    best = curve.agg(F.max(F.struct("r2", -F.col("columns"))).alias("x")).select((-F.col("x.col2")).alias("best"))
    return curve.join(F.broadcast(best)).select(F.col("columns").alias("components"), "r2", (F.col("columns") == F.col("best")).alias("chosen"))


def tcompcor_pool(spark: SparkSession, d: str) -> DataFrame:
    """The most variable tenth of the series; ties at the cut stay."""
    v = table(spark, d, "events").groupBy(F.col("user_id").alias("sid")).agg(F.var_pop("value").alias("v"))
    placed = ranked(v, [F.desc("v"), "sid"], "place")
    n = max(1, -(-placed.count() // 10))
    least = placed.filter(F.col("place") == n).select("v").first()
    return v.filter(F.col("v") >= F.lit(least["v"] if least else None)).select("sid", F.round("v", 5).alias("v"))


QUERIES = {f.__name__: f for f in (
    fracridge, fracridge_cv, eigenmaps_embed, diffusion_map, spectral_features, hilbert_envelope, band_filter, spectral_fill, sinkhorn, gromov_w, nordic_patch, bilateral, phase_corr, acompcor, glmdenoise, tcompcor_pool,
)}
ORACLES = {
    "bilateral": """WITH v AS (SELECT p_partkey % 10 AS x, p_partkey // 10 % 10 AS y, p_partkey // 100 AS z, p_size AS v FROM part), o AS (SELECT v.*, a.i, b.i AS j, c.i AS k FROM v, range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)),
        n AS (SELECT o.x, o.y, o.z, coalesce(w.v, 0) AS q, exp(-(i * i + j * j + k * k) / 4.5 - (coalesce(w.v, 0) - o.v) ** 2 / 50.0) AS w FROM o LEFT JOIN v w ON w.x = o.x + i AND w.y = o.y + j AND w.z = o.z + k)
        SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, round(sum(w * q) / sum(w), 6) AS v FROM n GROUP BY 1, 2, 3""",
    "tcompcor_pool": "WITH v AS (SELECT user_id AS sid, var_pop(value) AS v FROM events GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY v DESC) AS r, count(*) OVER () AS n FROM v) SELECT sid, round(v, 5) AS v FROM r WHERE r <= ceil(n / 10.0)",
}
