import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import lookups


def test_rows_of_one_place_are_weighed_once(spark):
    """100 copies of 20 places: kernels are of pairs of places, not of rows."""
    places, copies, weighed = 20, 100, spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, "a", i % places / 2.0, float(i % 7) if i % 5 else None) for i in range(places * copies)], "id long, b string, p double, x double")
    df = df.unionByName(spark.createDataFrame([(-1, None, 1.0, 2.0), (-2, "a", None, 2.0), (-3, "c", 1.0, None)], df.schema))
    kernel = F.udf(lambda d: weighed.add(1) or math.exp(-d), "double").asNondeterministic()
    got = {r.id: (r.smooth, r.n) for r in lookups.range_smooth(df, "b", "p", "x", 2.0, kernel(F.col("dist"))).collect()}
    assert len(got) == places * copies + 1 and got[-3] == (None, 1)
    assert weighed.value <= 4 * places * places
    p, x = np.array([i % places / 2.0 for i in range(places * copies)]), np.array([float(i % 7) if i % 5 else 0.0 for i in range(places * copies)])
    for i in range(places * copies):
        d = np.abs(p - p[i])
        w = np.where(d <= 2, np.exp(-d), 0)
        assert got[i] == (pytest.approx(w @ x / w.sum()), (d <= 2).sum())


def test_laplacian_broadcasts_no_mask(spark, capsys):
    k = F.col("id")
    voxels = spark.range(600).select("id", (k % 10).alias("x"), (F.floor(k / 10) % 10).alias("y"), F.floor(k / 100).alias("z")).filter("id % 7 > 0")
    out = lookups.grid_laplacian(voxels)
    out.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    kept = {i for i in range(600) if i % 7}
    steps = lambda i: [j for j, fine in ((i + 1, i % 10 < 9), (i - 1, i % 10 > 0), (i + 10, i // 10 % 10 < 9), (i - 10, i // 10 % 10 > 0), (i + 100, True), (i - 100, True)) if fine and j in kept]
    want = {(i, j): -1.0 for i in kept for j in steps(i)} | {(i, i): float(len(steps(i))) for i in kept}
    assert {(r.i, r.j): r.v for r in out.collect()} == want


def test_nearest_node_of_equal_nodes_is_the_smallest(spark):
    points = spark.createDataFrame([(1, 0, 5.0), (2, 0, 1.0), (3, 0, 3.0), (4, 1, 0.0)], "id long, cell int, pos double")
    nodes = spark.createDataFrame([(n, 0, p) for n, p in ((9, 4.0), (7, 4.0), (8, 4.0), (5, 2.0), (6, 2.0))], "node long, cell int, pos double")
    got = {r.id: (r.node, r.dist) for r in lookups.nearest_node(points, nodes, "cell", 1.0, 10.0).collect()}
    assert got == {1: (7, 1.0), 2: (5, 1.0), 3: (5, 1.0)}
