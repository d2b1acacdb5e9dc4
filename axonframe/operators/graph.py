"""Graphs as edge tables (i, j, w): everything is a join on a node and a sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.operators.moments import correlation
from axonframe.plans.session import cut
from axonframe.sources.series import DAILY, daily_channels
from axonframe.sources.tables import table


def adjacency(edges: DataFrame) -> DataFrame:
    """Correlations as a graph: negative weights become 0, the diagonal is dropped."""
    return edges.filter("ch_i <> ch_j").select(F.col("ch_i").alias("i"), F.col("ch_j").alias("j"), F.greatest("r", F.lit(0.0)).alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("w").alias("k"))


def laplacian(edges: DataFrame, normalise: bool = True) -> DataFrame:
    """(i, j, v): D - W, or I - D^-1/2 W D^-1/2 where isolated nodes get scale 0."""
    k = degrees(edges)
    diagonal = k.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v") if normalise else F.col("k").alias("v"))
    scale = k.select("i", F.when(F.col("k") > 0, 1 / F.sqrt("k")).otherwise(0.0).alias("s"))
    both = edges.join(scale, "i").join(scale.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
    return diagonal.unionByName(both.select("i", "j", (-F.col("w") * (F.col("s") * F.col("t") if normalise else F.lit(1.0))).alias("v")))


def null_model(edges: DataFrame) -> DataFrame:
    """(i, j, p): k_i k_j / 2m over all node pairs; nodes are few, and the join is on a constant key of the total."""
    k = degrees(edges)
    total = k.agg(F.sum("k").alias("m")).select(F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")).alias("m"), F.lit(1).alias("one"))
    a = k.withColumn("one", F.lit(1)).join(total, "one")
    return a.join(k.select(F.col("i").alias("j"), F.col("k").alias("l"), F.lit(1).alias("one")), "one").select("i", "j", (F.col("k") * F.col("l") / F.col("m")).alias("p"))


def modularity(edges: DataFrame, groups: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Q of hard groups (i, g), diagonal left out, from sums per group: no matrix is formed."""
    k = degrees(edges).join(groups, "i")
    inside = edges.join(groups, "i").join(groups.select(F.col("i").alias("j"), F.col("g").alias("h")), "j").filter("g = h AND i <> j").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    s = k.groupBy("g").agg(F.sum("k").alias("s"), F.sum(F.col("k") ** 2).alias("q")).agg(F.sum(F.col("s") ** 2 - F.col("q")).alias("e"), F.sum("s").alias("m"))
    m = F.when(F.col("m") == 0, 1.0).otherwise(F.col("m"))
    return inside.withColumn("one", F.lit(1)).join(s.withColumn("one", F.lit(1)), "one").select(((F.col("w") - gamma * F.col("e") / m) / m).alias("q"))


def aggregate(edges: DataFrame, nodes: DataFrame, features: DataFrame) -> DataFrame:
    """(j, total, mean, n): sum and weighted mean of the features (i, x) over in-edges; isolated targets get 0."""
    met = edges.join(features, "i").groupBy("j").agg(F.sum("x").alias("total"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("sw"), F.count("*").alias("n"))
    mean = F.col("wx") / F.when(F.coalesce("sw", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sw"))
    return nodes.join(met, "j", "left").select("j", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def chebyshev(lap: DataFrame, x: DataFrame, coeffs: list[float]) -> DataFrame:
    """sum_k c_k T_k(L - I) x of the signal (i, x), by the recurrence; each step is one sparse product. A step uses the last two terms, so lineage is cut after each."""
    lap = cut(lap)

    def apply(v: DataFrame) -> DataFrame:
        shifted = lap.join(v.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("lx"))
        return v.join(shifted, "i", "left").select("i", (F.coalesce("lx", F.lit(0.0)) - F.col("x")).alias("x"))

    terms = [cut(x)]
    if len(coeffs) > 1:
        terms.append(cut(apply(terms[0])))
    while len(terms) < len(coeffs):
        a = apply(terms[-1]).select("i", (2 * F.col("x")).alias("a"))
        terms.append(cut(a.join(terms[-2].select("i", F.col("x").alias("b")), "i").select("i", (F.col("a") - F.col("b")).alias("x"))))
    parts = [t.select("i", (F.col("x") * c).alias("y")) for t, c in zip(terms, coeffs, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("i").agg(F.sum("y").alias("y"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return adjacency(correlation(daily_channels(table(spark, d, "events"))))


def degree(spark: SparkSession, d: str) -> DataFrame:
    return degrees(_edges(spark, d)).select("i", F.round("k", 6).alias("k"))


def graph_laplacian(spark: SparkSession, d: str) -> DataFrame:
    return laplacian(_edges(spark, d)).select("i", "j", (F.round("v", 6) + 0.0).alias("v"))


def gn_null(spark: SparkSession, d: str) -> DataFrame:
    return null_model(_edges(spark, d)).select("i", "j", F.round("p", 6).alias("p"))


def modularity_q(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return modularity(e, e.select("i").distinct().withColumn("g", F.when(F.col("i") < "m", 0).otherwise(1))).select(F.round("q", 6).alias("q"))


def edge_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).filter("w > 0.05").select("i", "j", F.round("w", 6).alias("w"))


def _trade(spark: SparkSession, d: str) -> DataFrame:
    """Supplier -> customer edges, weighted by quantity; one per order line."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("j"))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("i"), F.col("l_quantity").alias("w")).join(o, "l_orderkey").select("i", "j", "w")


def sparse_degree(spark: SparkSession, d: str) -> DataFrame:
    n = _trade(spark, d).groupBy("i").count()
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("i")).join(n, "i", "left").select("i", F.coalesce("count", F.lit(0)).alias("n"))


def graph_conv(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"))
    got = aggregate(_trade(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("j")), x)
    return got.select("j", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), "n")


def chebyshev_filter(spark: SparkSession, d: str) -> DataFrame:
    long = daily_channels(table(spark, d, "events"))
    x = long.groupBy(F.col("ch").alias("i")).agg(F.avg("v").alias("x"))
    return chebyshev(laplacian(_edges(spark, d)), x, [0.5, 0.3, 0.2]).select("i", F.round("y", 5).alias("y"))


_E = f"""{DAILY}, pr AS (SELECT a.ch AS i, b.ch AS j, coalesce(covar_samp(a.v, b.v) / nullif(stddev_samp(a.v) * stddev_samp(b.v), 0), 0) AS r FROM long a JOIN long b ON a.tr = b.tr GROUP BY 1, 2),
    e AS (SELECT i, j, greatest(r, 0) AS w FROM pr WHERE i <> j), k AS (SELECT i, sum(w) AS k FROM e GROUP BY 1)"""
_L = f"""{_E}, sc AS (SELECT i, CASE WHEN k > 0 THEN 1 / sqrt(k) ELSE 0 END AS s FROM k), l AS (SELECT i, i AS j, CAST(1 AS DOUBLE) AS v FROM k UNION ALL SELECT e.i, e.j, -w * a.s * b.s FROM e JOIN sc a ON a.i = e.i JOIN sc b ON b.i = e.j)"""
_G = "t AS (SELECT l_suppkey AS i, o_custkey AS j, l_quantity AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
QUERIES = {"degree": degree, "laplacian": graph_laplacian, "gn_null": gn_null, "modularity": modularity_q, "edge_threshold": edge_threshold, "sparse_degree": sparse_degree, "graph_conv": graph_conv, "chebyshev": chebyshev_filter}
ORACLES = {
    "degree": f"WITH {_E} SELECT i, round(k, 6) AS k FROM k",
    "laplacian": f"WITH {_L} SELECT i, j, round(v, 6) + 0.0 AS v FROM l",
    "gn_null": f"WITH {_E} SELECT a.i, b.i AS j, round(a.k * b.k / (SELECT sum(k) FROM k), 6) AS p FROM k a, k b",
    "modularity": f"""WITH {_E}, m AS (SELECT sum(k) AS m FROM k) SELECT round(sum(e.w - a.k * b.k / m) / any_value(m), 6) AS q FROM k a JOIN k b ON a.i <> b.i AND (a.i < 'm') = (b.i < 'm') JOIN e ON e.i = a.i AND e.j = b.i, m""",
    "edge_threshold": f"WITH {_E} SELECT i, j, round(w, 6) AS w FROM e WHERE w > 0.05",
    "sparse_degree": f"WITH {_G} SELECT s_suppkey AS i, count(t.i) AS n FROM supplier LEFT JOIN t ON t.i = s_suppkey GROUP BY 1",
    "graph_conv": f"WITH {_G} SELECT c_custkey AS j, round(coalesce(sum(s_acctbal), 0), 2) AS total, round(coalesce(sum(w * s_acctbal) / sum(w), 0), 6) AS mean, count(s_acctbal) AS n FROM customer LEFT JOIN (t JOIN supplier ON s_suppkey = t.i) ON t.j = c_custkey GROUP BY 1",
    "chebyshev": f"""WITH {_L}, x AS (SELECT ch AS i, avg(v) AS x FROM long GROUP BY 1), t1 AS (SELECT x.i, coalesce(sum(l.v * y.x), 0) - any_value(x.x) AS x FROM x LEFT JOIN l ON l.i = x.i LEFT JOIN x y ON y.i = l.j GROUP BY 1),
        t2 AS (SELECT t1.i, 2 * (coalesce(sum(l.v * y.x), 0) - any_value(t1.x)) - any_value(x.x) AS x FROM t1 JOIN x ON x.i = t1.i LEFT JOIN l ON l.i = t1.i LEFT JOIN t1 y ON y.i = l.j GROUP BY 1)
        SELECT x.i, round(0.5 * x.x + 0.3 * t1.x + 0.2 * t2.x, 5) AS y FROM x JOIN t1 ON t1.i = x.i JOIN t2 ON t2.i = x.i""",
}
