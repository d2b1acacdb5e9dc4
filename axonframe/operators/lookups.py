"""Joins: masks, re-indexing, default fill, nearest node, range-kernel smoothing, grid neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.sources.tables import table


def masked(rows: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    return rows.join(mask.select(key), key, "left_semi")


def reindexed(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Where each element of one mask stands in the other: both are ranked by key within ``value``."""
    rank = lambda df, name: df.withColumn(name, F.row_number().over(W.partitionBy(value).orderBy(key)).cast("long") - 1)
    return rank(left, "from_index").join(rank(right, "to_index").select(key, "to_index"), key)


def default_fill(rows: DataFrame, values: DataFrame, key: str, value: str, default: float) -> DataFrame:
    return rows.join(values.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def nearest_node(points: DataFrame, nodes: DataFrame, cell: str, width: float, reach: float) -> DataFrame:
    """(id, node, dist): the nearest node of each point on the line ``pos`` within its ``cell``, weight 0 beyond ``reach``.

    Points and nodes of a cell meet in one ordered pass: the nearest node is the last before or the
    first after, so no pairs are made. Ties go to the smaller node; of nodes at one place only the smallest takes part.
    """
    nodes = nodes.groupBy(cell, "pos").agg(F.min("node").alias("node"))
    both = points.select(cell, "pos", F.col("id").alias("id"), F.lit(None).cast("long").alias("node")).unionByName(nodes.select(cell, "pos", F.lit(None).cast("long").alias("id"), F.col("node")))
    order = W.partitionBy(cell).orderBy("pos", "node", "id")
    mark = F.when(F.col("node").isNotNull(), F.struct(F.col("pos").alias("p"), "node"))
    back = F.last(mark, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.last(mark, ignorenulls=True).over(W.partitionBy(cell).orderBy(F.desc("pos"), F.desc("node"), F.desc("id")).rowsBetween(W.unboundedPreceding, -1))
    d = lambda x: F.struct(F.abs(F.col("pos") - x["p"]).alias("dist"), x["node"].alias("node"))
    best = F.least(F.when(back.isNotNull(), d(back)), F.when(ahead.isNotNull(), d(ahead)))
    found = both.withColumn("best", best).filter("id IS NOT NULL AND best IS NOT NULL")
    return found.select("id", "best.node", "best.dist", F.when(F.col("best.dist") <= reach, 1.0).otherwise(0.0).alias("weight"))


def range_smooth(rows: DataFrame, cell: str, pos: str, value: str, radius: float, kernel: Column) -> DataFrame:
    """Row-normalised kernel average over all rows of the same cell within ``radius``; ``kernel`` is of column ``dist``.

    Rows of one place are one with the sum of their values and their number. Places are dealt to slots of one
    radius and meet their own and the two next ones in an equi-join; rows get the sums of their place.
    """
    slot = F.floor(F.col(pos) / radius)
    places = rows.groupBy(cell, pos).agg(F.sum(value).alias("x"), F.count("*").alias("n"))
    a = places.select(cell, F.col(pos).alias("p"), F.explode(F.sequence(slot - 1, slot + 1)).alias("slot"))
    b = places.select(cell, F.col(pos).alias("q"), "x", "n", slot.alias("slot"))
    near = a.join(b, [cell, "slot"]).withColumn("dist", F.abs(F.col("p") - F.col("q"))).filter(F.col("dist") <= radius)
    sums = near.withColumn("w", kernel).groupBy(cell, F.col("p").alias(pos)).agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum(F.col("w") * F.col("n")).alias("w"), F.sum("n").alias("n"))
    return rows.select("id", cell, pos).join(sums, [cell, pos]).groupBy("id").agg((F.sum("wx") / (F.sum("w") + 1e-12)).alias("smooth"), F.sum("n").alias("n"))


def grid_laplacian(voxels: DataFrame) -> DataFrame:
    """(i, j, v) of L = D - A over the six neighbours inside the mask (id, x, y, z).

    Each join is of two sides as large as the mask, however small their stored columns are, so none is broadcast.
    """
    steps = F.array(*(F.struct(*(F.lit(c).alias(n) for n, c in zip("xyz", s, strict=True))) for s in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))))
    out = voxels.withColumn("d", F.explode(steps)).select(F.col("id").alias("i"), *((F.col(c) + F.col(f"d.{c}")).alias(c) for c in "xyz"))
    edges = out.join(voxels.withColumnRenamed("id", "j").hint("merge"), ["x", "y", "z"]).select("i", "j")
    degree = voxels.select(F.col("id").alias("i")).join(edges.groupBy("i").count().hint("merge"), "i", "left").select("i", F.col("i").alias("j"), F.coalesce(F.col("count").cast("double"), F.lit(0.0)).alias("v"))
    return degree.unionByName(edges.withColumn("v", F.lit(-1.0)))


def mask_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return masked(table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 1"), "doc_id").select("doc_id", "lang", "n_chars")


def reindex_join(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return reindexed(part.filter("p_size <= 25"), part.filter("p_size >= 10"), "p_partkey", "p_brand").select("p_partkey", "from_index", "to_index")


def default_fill_join(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("frac"))
    return default_fill(table(spark, d, "documents").select("doc_id"), q, "doc_id", "frac", 1.0)


def nearest_supplier(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("cell"), F.col("c_acctbal").alias("pos"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 5).alias("cell"), F.col("s_acctbal").alias("pos"))
    return nearest_node(c, s, "cell", 1.0, 500.0).select("id", "node", F.round("dist", 4).alias("dist"), "weight")


def range_kernel_smooth(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("x"))
    return range_smooth(p, "p_brand", "p_retailprice", "x", 5.0, F.exp(-F.col("dist") * F.col("dist") / 8)).select("id", F.round("smooth", 6).alias("smooth"), "n")


def six_neighbour_laplacian(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    v = table(spark, d, "part").filter("p_size > 5").select(k.alias("id"), (k % 10).alias("x"), (F.floor(k / 10) % 10).alias("y"), F.floor(k / 100).alias("z"))
    return grid_laplacian(v)


QUERIES = {f.__name__: f for f in (mask_semi_join, reindex_join, default_fill_join, nearest_supplier, range_kernel_smooth, six_neighbour_laplacian)}
ORACLES = {
    "mask_semi_join": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "reindex_join": """WITH a AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS from_index FROM part WHERE p_size <= 25),
        b AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS to_index FROM part WHERE p_size >= 10) SELECT p_partkey, from_index, to_index FROM a JOIN b USING (p_partkey)""",
    "default_fill_join": "SELECT doc_id, coalesce(CAST(quality AS DOUBLE), 1.0) AS frac FROM documents LEFT JOIN labels USING (doc_id)",
    "nearest_supplier": """WITH j AS (SELECT c_custkey AS id, s_suppkey AS node, abs(c_acctbal - s_acctbal) AS dist FROM customer JOIN supplier ON c_nationkey % 5 = s_nationkey % 5)
        SELECT id, arg_min(node, (dist, node)) AS node, round(min(dist), 4) AS dist, CASE WHEN min(dist) <= 500 THEN 1.0 ELSE 0.0 END AS weight FROM j GROUP BY 1""",
    "range_kernel_smooth": """WITH j AS (SELECT a.p_partkey AS id, exp(-((a.p_retailprice - b.p_retailprice) ** 2) / 8) AS w, b.p_size AS x FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_retailprice - b.p_retailprice) <= 5)
        SELECT id, round(sum(w * x) / (sum(w) + 1e-12), 6) AS smooth, count(*) AS n FROM j GROUP BY 1""",
    "six_neighbour_laplacian": """WITH v AS (SELECT p_partkey AS id, p_partkey % 10 AS x, p_partkey // 10 % 10 AS y, p_partkey // 100 AS z FROM part WHERE p_size > 5),
        e AS (SELECT a.id AS i, b.id AS j FROM v a JOIN v b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1)
        SELECT i, j, -1.0::DOUBLE AS v FROM e UNION ALL SELECT id, id, CAST((SELECT count(*) FROM e WHERE i = id) AS DOUBLE) FROM v""",
}
