import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import sphere


def angles(p, q):
    u = lambda x: np.stack([np.cos(x[:, 0]) * np.cos(x[:, 1]), np.cos(x[:, 0]) * np.sin(x[:, 1]), np.sin(x[:, 0])], 1)
    a, b = u(p), u(q)
    return np.arctan2(np.linalg.norm(np.cross(a[:, None], b[None]), axis=2), a @ b.T)


def points(n, seed):
    """Spread evenly, and some at the poles, along the seam and twice at one place."""
    rng = np.random.default_rng(seed)
    p = np.stack([np.arcsin(rng.uniform(-1, 1, n)), rng.uniform(-math.pi, math.pi, n)], 1)
    odd = [[math.pi / 2, 0.3], [math.pi / 2, -2], [-math.pi / 2, 1], [math.pi / 2 - 0.01, 3], [0, math.pi], [0, -math.pi], [0.001, math.pi - 1e-9], [0.2, 2 * math.pi + 0.1], [0.2, 0.1]]
    return np.concatenate([p, odd])


@pytest.mark.parametrize("radius", [0.05, 0.31, 1.2])
def test_pairs_are_those_of_brute_force(spark, radius):
    p = points(400, 3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(10_000, None, 1.0)], "id long, lat double, lon double")
    got = {(r.id, r.other): r.angle for r in sphere.within(df, df, radius).collect()}
    d = angles(p, p)
    sure = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius - 1e-9), strict=True)}
    perhaps = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius + 1e-9), strict=True)}
    assert sure <= set(got) <= perhaps and all(abs(v - d[k]) < 1e-7 for k, v in got.items())


def test_pairs_that_meet_grow_with_the_hits(spark):
    p, radius = points(3000, 4), 0.08
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, lat double, lon double")
    ring = sphere.ring_of(F.col("lat"), radius)
    cell = df.select(ring.alias("ring"), sphere.cell_of(F.col("lon"), sphere.cells_in(ring, radius)).alias("cell"))
    met = df.select(F.explode(sphere.reached(F.col("lat"), F.col("lon"), radius)).alias("c")).select("c.*").join(cell, ["ring", "cell"]).count()
    hits = int((angles(p, p) <= radius).sum())
    assert met < 6 * hits and met < 0.03 * len(p) ** 2


def test_convolution_keeps_constants_and_smooths(spark):
    p = points(500, 5)
    rng = np.random.default_rng(6)
    x = rng.normal(size=len(p))
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(p, x, strict=True))], "id long, lat double, lon double, x double")
    assert all(abs(r.v - 2) < 1e-12 for r in sphere.convolved(df.withColumn("x", F.lit(2.0)), "x", 0.3, 0.1).collect())
    for kernel, of in (("gaussian", lambda d: np.exp(-(d**2) / 0.02)), ("exponential", lambda d: np.exp(-d / 0.1))):
        d = angles(p, p)
        w = np.where(d <= 0.3, of(d), 0)
        got = {r.id: r.v for r in sphere.convolved(df, "x", 0.3, 0.1, kernel).collect()}
        assert np.allclose([got[i] for i in range(len(p))], w @ x / w.sum(1), atol=1e-6)
    with pytest.raises(ValueError):
        sphere.within(df, df, 2.0)
    assert sphere.convolved(df.limit(0), "x", 0.3, 0.1).count() == 0


def test_convolution_of_copies_in_tiles(spark, monkeypatch, capsys):
    """Places are weighed once, in tiles of a bounded size, and no side of a join is broadcast."""
    k = F.col("id")
    df = spark.range(900).select("id", ((k % 30) / 20.0 - 0.7).alias("lat"), ((k * 7 % 90) / 60.0).alias("lon"), F.when(k % 4 > 0, (k % 11).cast("double")).alias("x"))
    monkeypatch.setattr(sphere, "TILE", 5)
    monkeypatch.setattr(sphere, "HELD", 50)
    out = sphere.convolved(df, "x", 0.3, 0.1)
    out.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    got = {r.id: (r.v, r.n) for r in out.collect()}
    rows = df.collect()
    p, x = np.array([(r.lat, r.lon) for r in rows]), np.array([math.nan if r.x is None else r.x for r in rows])
    d = angles(p, p)
    w, fine = np.where(d <= 0.3, np.exp(-(d**2) / 0.02), 0) * np.isfinite(x), np.nan_to_num(x)
    assert got == {r.id: (pytest.approx(w[i] @ fine / w[i].sum()), ((d[i] <= 0.3) & np.isfinite(x)).sum()) for i, r in enumerate(rows)}
