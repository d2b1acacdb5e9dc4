import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import spatial


def copied(spark, name, seed, copies=60):
    """Nine places, each ``copies`` times."""
    rng = np.random.default_rng(seed)
    p = np.tile(rng.uniform(0, 4, (9, 3)), (copies, 1))
    v = rng.normal(size=len(p))
    return spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(p, v, strict=True))], f"{name} long, x double, y double, z double, v double"), p, v


def test_nearest_of_copies_is_found_by_place(spark, monkeypatch):
    met, whole = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a: met.append(whole(*a)) or met[-1])
    (points, p, _), (nodes, q, _) = copied(spark, "id", 1), copied(spark, "node", 2)
    lost = spark.createDataFrame([(-1, None, 1.0, 1.0), (-2, 50.0, 50.0, 50.0)], "id long, x double, y double, z double")
    got = {r.id: r for r in spatial.nearest_within(points.drop("v").unionByName(lost), nodes, 2.0).collect()}
    assert met[0].count() <= 81
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    assert len(got) == len(p) + 2 and (got[-1].node, got[-1].weight, got[-2].dist, got[-2].weight) == (None, 0.0, None, 0.0)
    for i in range(len(p)):
        near = d[i].min() <= 2
        assert (got[i].node, got[i].dist, got[i].weight) == ((int(d[i].argmin()), pytest.approx(d[i].min()), 1.0) if near else (None, None, 0.0))


def test_kernel_sums_of_copies_meet_by_place(spark, monkeypatch):
    met, whole = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a: met.append(whole(*a)) or met[-1])
    (points, p, _), (nodes, q, v) = copied(spark, "id", 3), copied(spark, "node", 4)
    nodes = nodes.withColumn("v", F.when(F.col("node") % 4 > 0, F.col("v")))
    got = {r.id: (r.v, r.n) for r in spatial.kernel_sum(points.drop("v"), nodes, 2.0, F.exp(-F.col("dist"))).collect()}
    assert met[0].count() <= 81
    d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
    w, v = np.where(d <= 2, np.exp(-d), 0), np.where(np.arange(len(v)) % 4 > 0, v, 0)
    want = {i: (pytest.approx(w[i] @ v / (w[i].sum() + 1e-12)), (d[i] <= 2).sum()) for i in range(len(p)) if (d[i] <= 2).any()}
    assert got == want


def test_tasks_of_a_product_grow_with_the_entries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = (np.where(rng.uniform(size=(40, 40)) < 0.2, rng.integers(-3, 4, (40, 40)), 0).astype(float) for _ in range(2))
    sparse = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, v double")
    monkeypatch.setattr(spatial, "ENTRIES", 20)
    out = spatial.product(sparse(a), sparse(b))
    assert out.rdd.getNumPartitions() == -(-np.count_nonzero(a) // 20)
    got = np.zeros((40, 40))
    for r in out.collect():
        got[r.i, r.j] = r.v
    assert (got == a @ b).all()
