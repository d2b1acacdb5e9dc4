"""Points and voxels in three dimensions: nearest node, kernel sums within a radius, mask unions, products of sparse matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.operators.lookups import grid_laplacian
from axonframe.operators.selection import eroded
from axonframe.plans.session import cut
from axonframe.sources.tables import table

#: Entries of a sparse matrix in a task of its products.
ENTRIES = 100_000


def within(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """(id, node, dist, ...) of all pairs of points (id, x, y, z) and nodes (node, x, y, z, ...) no further than ``radius``.

    Both are dealt to cubes of that width; a point meets the nodes of its own and the 26 cubes around it.
    """
    cube = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.array(*(F.struct(*(F.lit(s).alias(f"d{c}") for c, s in zip("xyz", (i, j, k), strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    a = points.withColumn("s", F.explode(around)).select("id", *(F.col(c).alias(f"p{c}") for c in "xyz"), *((cube(c) + F.col(f"s.d{c}")).alias(f"c{c}") for c in "xyz"))
    b = nodes.withColumns({f"c{c}": cube(c) for c in "xyz"})
    dist = F.sqrt(sum((F.col(f"p{c}") - F.col(c)) ** 2 for c in "xyz"))
    return a.join(b, ["cx", "cy", "cz"]).withColumn("dist", dist).filter(F.col("dist") <= radius).drop("cx", "cy", "cz", "px", "py", "pz", "x", "y", "z")


def places(points: DataFrame) -> DataFrame:
    """Distinct places of points, each named by itself."""
    return points.select("x", "y", "z").distinct().withColumn("id", F.struct("x", "y", "z"))


def nearest_within(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """(id, node, dist, weight): the nearest node, ties to the smaller; points without one in reach have weight 0.

    Points of one place meet the nodes once, and of the nodes of one place only the smallest can be found.
    """
    at = F.struct("x", "y", "z")
    first = nodes.groupBy("x", "y", "z").agg(F.min("node").alias("node"))
    best = within(places(points), first, radius).groupBy(F.col("id").alias("at")).agg(F.min(F.struct("dist", "node")).alias("b"))
    return points.select("id", at.alias("at")).join(best, "at", "left").select("id", "b.node", "b.dist", F.when(F.col("b").isNotNull(), 1.0).otherwise(0.0).alias("weight"))


def kernel_sum(points: DataFrame, nodes: DataFrame, radius: float, kernel: Column) -> DataFrame:
    """Row-normalised kernel average of the nodes' v within ``radius``; ``kernel`` is of column ``dist``.

    Points of one place meet the nodes once, and nodes of one place are one with the sum of their v and their number.
    """
    summed = nodes.groupBy("x", "y", "z").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    w = within(places(points), summed, radius).withColumn("w", kernel)
    sums = w.groupBy(F.col("id").alias("at")).agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum(F.col("w") * F.col("n")).alias("w"), F.sum("n").alias("n"))
    rows = points.select("id", F.struct("x", "y", "z").alias("at")).join(sums, "at")
    return rows.groupBy("id").agg((F.sum("wv") / (F.sum("w") + 1e-12)).alias("v"), F.sum("n").alias("n"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a b, both sparse (i, j, v) and stored, as they are counted first.

    Both the entries that meet and the products that are summed up are dealt to as many tasks as there are
    entries for, so what a task holds doesn't grow with the matrices.
    """
    tasks = max(1, -(-a.count() // ENTRIES))
    left = a.select("i", F.col("j").alias("k"), "v").repartition(tasks, "k")
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("w")).repartition(tasks, "k")
    met = left.join(right, "k").select("i", "j", (F.col("v") * F.col("w")).alias("v")).repartition(tasks, "i", "j")
    return met.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _grid(spark: SparkSession, d: str, keep: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").filter(keep).select(k.alias("id"), (k % 10).alias("x"), (F.floor(k / 10) % 10).alias("y"), F.floor(k / 100).alias("z"))


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    points = table(spark, d, "part").select(k.alias("id"), *((k * m % 97 / 9.7).alias(c) for c, m in zip("xyz", (13, 29, 53), strict=True)))
    nodes = table(spark, d, "supplier").select(s.alias("node"), *((s * m % 89 / 8.9).alias(c) for c, m in zip("xyz", (17, 31, 47), strict=True)), F.col("s_acctbal").alias("v"))
    return points, nodes


def nearest_3d(spark: SparkSession, d: str) -> DataFrame:
    return nearest_within(*_points(spark, d), 3.0).select("id", "node", F.round("dist", 6).alias("dist"), "weight")


def spatial_conv(spark: SparkSession, d: str) -> DataFrame:
    return kernel_sum(*_points(spark, d), 3.0, F.exp(-F.col("dist") ** 2 / 2)).select("id", F.round("v", 4).alias("v"), "n")


def laplacian_square(spark: SparkSession, d: str) -> DataFrame:
    """L'L of the six-neighbour graph, by which estimates are smoothed."""
    lap = cut(grid_laplacian(_grid(spark, d, "p_size > 5")))
    return product(lap.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), lap).filter("v <> 0")


def eroded_union(spark: SparkSession, d: str) -> DataFrame:
    """Voxels that the erosion of either of two masks keeps."""
    return eroded(_grid(spark, d, "p_size > 2")).union(eroded(_grid(spark, d, "p_size < 49"))).distinct()


def label_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


_XYZ = "p_partkey AS id, p_partkey % 10 AS x, p_partkey // 10 % 10 AS y, p_partkey // 100 AS z FROM part"
_PN = """p AS (SELECT p_partkey AS id, p_partkey * 13 % 97 / 9.7 AS x, p_partkey * 29 % 97 / 9.7 AS y, p_partkey * 53 % 97 / 9.7 AS z FROM part),
    n AS (SELECT s_suppkey AS node, s_suppkey * 17 % 89 / 8.9 AS x, s_suppkey * 31 % 89 / 8.9 AS y, s_suppkey * 47 % 89 / 8.9 AS z, s_acctbal AS v FROM supplier),
    d AS (SELECT id, node, v, sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2 + (p.z - n.z) ** 2) AS dist FROM p, n), w AS (SELECT * FROM d WHERE dist <= 3)"""
_ERODED = "(SELECT a.id FROM {v} a JOIN {v} b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 GROUP BY 1 HAVING count(*) = 6)"
QUERIES = {f.__name__: f for f in (nearest_3d, spatial_conv, laplacian_square, eroded_union, label_filter)}
ORACLES = {
    "nearest_3d": f"WITH {_PN}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, node) AS k FROM w) SELECT p.id, node, round(dist, 6) AS dist, CASE WHEN node IS NULL THEN 0.0 ELSE 1.0 END AS weight FROM p LEFT JOIN r ON r.id = p.id AND k = 1",
    "spatial_conv": f"WITH {_PN} SELECT id, round(sum(exp(-dist * dist / 2) * v) / (sum(exp(-dist * dist / 2)) + 1e-12), 4) AS v, count(*) AS n FROM w GROUP BY 1",
    "laplacian_square": f"""WITH v AS (SELECT {_XYZ} WHERE p_size > 5), e AS (SELECT a.id AS i, b.id AS j FROM v a JOIN v b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
        l AS (SELECT i, j, -1.0::DOUBLE AS v FROM e UNION ALL SELECT id, id, (SELECT count(*) FROM e WHERE i = id)::DOUBLE FROM v) SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM l a JOIN l b ON a.i = b.i GROUP BY 1, 2 HAVING sum(a.v * b.v) <> 0""",
    "eroded_union": f"WITH a AS (SELECT {_XYZ} WHERE p_size > 2), b AS (SELECT {_XYZ} WHERE p_size < 49) {_ERODED.format(v='a')} UNION {_ERODED.format(v='b')}",
    "label_filter": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')",
}
