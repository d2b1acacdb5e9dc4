"""Objective functions as aggregates: divergences, graph smoothness, spatial compactness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.graph import adjacency
from axonframe.operators.moments import correlation
from axonframe.sources.series import DAILY, daily_channels
from axonframe.sources.tables import table

EPS = 1e-8


def clip(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(EPS))


def entropies(dist: DataFrame) -> DataFrame:
    """Natural-log entropy of (sid, c, p)."""
    p = clip(F.col("p"))
    return dist.groupBy("sid").agg((-F.sum(p * F.log(p))).alias("entropy"))


def kullback(dist: DataFrame) -> DataFrame:
    """KL(p || q) of (sid, c, p, q)."""
    p, q = clip(F.col("p")), clip(F.col("q"))
    return dist.groupBy("sid").agg(F.sum(p * (F.log(p) - F.log(q))).alias("kl"))


def jensen(dist: DataFrame) -> DataFrame:
    p, q = clip(F.col("p")), clip(F.col("q"))
    m = (p + q) / 2
    return dist.groupBy("sid").agg((0.5 * F.sum(p * (F.log(p) - F.log(m))) + 0.5 * F.sum(q * (F.log(q) - F.log(m)))).alias("js"))


def connectopy(edges: DataFrame, coords: DataFrame) -> DataFrame:
    """sum A |q_i - q_j|^2 / sum A over edges (i, j, w) and coordinates (i, x)."""
    both = edges.join(coords, "i").join(coords.select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
    return both.agg((F.sum(F.col("w") * (F.col("x") - F.col("y")) ** 2) / F.sum("w")).alias("loss"))


def eigenmaps_loss(edges: DataFrame, coords: DataFrame) -> DataFrame:
    """tr(Q'LQ) / tr(Q'DQ) for one coordinate, with L = D - W: half the summed edge differences over the degree-weighted squares."""
    both = edges.join(coords, "i").join(coords.select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
    return both.agg((0.5 * F.sum(F.col("w") * (F.col("x") - F.col("y")) ** 2) / F.sum(F.col("w") * F.col("x") ** 2)).alias("loss"))


def centroids(points: DataFrame) -> DataFrame:
    """(g, mx, my, sw) of (g, w, x, y)."""
    return points.groupBy("g").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"), F.sum("w").alias("sw"))


def compactness(points: DataFrame) -> DataFrame:
    """Weighted mean distance of each group's points to its centroid."""
    d = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    return points.join(centroids(points), "g").groupBy("g").agg((F.sum(F.col("w") * d) / F.sum("w")).alias("loss"))


def dispersion(points: DataFrame) -> DataFrame:
    """Minus the mean distance between centroids of different groups (groups are few)."""
    c = centroids(points).withColumn("one", F.lit(1))
    o = c.select("one", F.col("g").alias("h"), F.col("mx").alias("nx"), F.col("my").alias("ny"))
    return c.join(o, "one").filter("g < h").agg((-F.avg(F.sqrt((F.col("mx") - F.col("nx")) ** 2 + (F.col("my") - F.col("ny")) ** 2))).alias("loss"))


def tether(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Distance of each group's centroid to its reference (g, rx, ry)."""
    return centroids(points).join(reference, "g").select("g", F.sqrt((F.col("mx") - F.col("rx")) ** 2 + (F.col("my") - F.col("ry")) ** 2).alias("loss"))


def equilibrium(assignment: DataFrame) -> DataFrame:
    """Minus the entropy of the group shares of (g, w)."""
    p = assignment.groupBy("g").agg(F.sum("w").alias("s")).withColumn("p", clip(F.col("s") / F.sum("s").over(W.partitionBy())))
    return p.agg(F.sum(F.col("p") * F.log("p")).alias("loss"))


def qcfc(edges: DataFrame, quality: DataFrame) -> DataFrame:
    """Mean |corr(edge, quality)| over subjects: (sid, edge, v) and (sid, q), population sd + 1e-8."""
    both = edges.join(quality, "sid").groupBy("edge").agg((F.covar_pop("v", "q") / ((F.stddev_pop("v") + EPS) * (F.stddev_pop("q") + EPS))).alias("r"))
    return both.agg(F.avg(F.abs("r")).alias("loss"), F.count("*").alias("n"))


def weighted_loss(rows: DataFrame) -> DataFrame:
    """sum l |w| / (sum |w| + 1e-8) of (l, w)."""
    return rows.agg((F.sum(F.col("l") * F.abs("w")) / (F.sum(F.abs("w")) + EPS)).alias("loss"))


def _dist(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("sid"), F.col("event_type").alias("c")).agg(F.count("*").alias("n"))
    q = n.groupBy("c").agg(F.sum("n").alias("m")).withColumn("q", F.col("m") / F.sum("m").over(W.partitionBy()))
    return n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("sid"))).join(q.select("c", "q"), "c")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    long = daily_channels(table(spark, d, "events"))
    return adjacency(correlation(long)), long.groupBy(F.col("ch").alias("i")).agg(F.avg("v").alias("x"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), (1.0 + F.col("c_custkey") % 4).alias("w"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


def _round(df: DataFrame, col: str, n: int = 6) -> DataFrame:
    return df.withColumn(col, F.round(col, n))


def entropy(spark: SparkSession, d: str) -> DataFrame:
    return _round(entropies(_dist(spark, d)), "entropy")


def kl_divergence(spark: SparkSession, d: str) -> DataFrame:
    return _round(kullback(_dist(spark, d)), "kl")


def js_divergence(spark: SparkSession, d: str) -> DataFrame:
    return _round(jensen(_dist(spark, d)), "js")


def connectopy_loss(spark: SparkSession, d: str) -> DataFrame:
    return _round(connectopy(*_graph(spark, d)), "loss")


def eigenmaps(spark: SparkSession, d: str) -> DataFrame:
    return _round(eigenmaps_loss(*_graph(spark, d)), "loss", 8)


def compactness_loss(spark: SparkSession, d: str) -> DataFrame:
    return _round(compactness(_points(spark, d)), "loss", 5)


def dispersion_loss(spark: SparkSession, d: str) -> DataFrame:
    return _round(dispersion(_points(spark, d)), "loss", 5)


def tether_loss(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return _round(tether(p, p.groupBy("g").agg(F.min("x").alias("rx"), F.min("y").alias("ry"))), "loss", 5)


def equilibrium_loss(spark: SparkSession, d: str) -> DataFrame:
    return _round(equilibrium(_points(spark, d)), "loss")


def qcfc_loss(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    edges = e.groupBy(F.col("user_id").alias("sid"), F.col("event_type").alias("edge")).agg(F.avg("value").alias("v"))
    return _round(qcfc(edges, e.groupBy(F.col("user_id").alias("sid")).agg(F.count("*").cast("double").alias("q"))), "loss")


def reliability_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _round(weighted_loss(table(spark, d, "lineitem").select(F.col("l_discount").alias("l"), (F.col("l_quantity") - 25).alias("w"))), "loss", 8)


_D = """n AS (SELECT user_id AS sid, event_type AS c, count(*) AS n FROM events GROUP BY 1, 2), q AS (SELECT event_type AS c, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM events) AS q FROM events GROUP BY 1),
    d AS (SELECT sid, n / CAST(sum(n) OVER (PARTITION BY sid) AS DOUBLE) AS p, q FROM n JOIN q USING (c))"""
_E = f"""{DAILY}, x AS (SELECT ch, avg(v) AS x FROM long GROUP BY 1), e AS (SELECT a.ch AS i, b.ch AS j, greatest(coalesce(covar_samp(a.v, b.v) / nullif(stddev_samp(a.v) * stddev_samp(b.v), 0), 0), 0) AS w FROM long a JOIN long b ON a.tr = b.tr AND a.ch <> b.ch GROUP BY 1, 2),
    g AS (SELECT w, a.x AS x, b.x AS y FROM e JOIN x a ON a.ch = i JOIN x b ON b.ch = j)"""
_P = "p AS (SELECT c_mktsegment AS g, 1.0 + c_custkey % 4 AS w, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), c AS (SELECT g, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM p GROUP BY 1)"
QUERIES = {f.__name__: f for f in (entropy, kl_divergence, js_divergence, connectopy_loss, compactness_loss, dispersion_loss, tether_loss, equilibrium_loss, qcfc_loss, reliability_weighted)} | {"eigenmaps_loss": eigenmaps}
ORACLES = {
    "entropy": f"WITH {_D} SELECT sid, round(-sum(p * ln(p)), 6) AS entropy FROM d GROUP BY 1",
    "kl_divergence": f"WITH {_D} SELECT sid, round(sum(p * ln(p / q)), 6) AS kl FROM d GROUP BY 1",
    "js_divergence": f"WITH {_D} SELECT sid, round(0.5 * sum(p * ln(2 * p / (p + q))) + 0.5 * sum(q * ln(2 * q / (p + q))), 6) AS js FROM d GROUP BY 1",
    "connectopy_loss": f"WITH {_E} SELECT round(sum(w * (x - y) ** 2) / sum(w), 6) AS loss FROM g",
    "eigenmaps_loss": f"WITH {_E} SELECT round(0.5 * sum(w * (x - y) ** 2) / sum(w * x * x), 8) AS loss FROM g",
    "compactness_loss": f"WITH {_P} SELECT g, round(sum(w * sqrt((x - mx) ** 2 + (y - my) ** 2)) / sum(w), 5) AS loss FROM p JOIN c USING (g) GROUP BY 1",
    "dispersion_loss": f"WITH {_P} SELECT round(-avg(sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2)), 5) AS loss FROM c a JOIN c b ON a.g < b.g",
    "tether_loss": f"WITH {_P}, r AS (SELECT g, min(x) AS rx, min(y) AS ry FROM p GROUP BY 1) SELECT g, round(sqrt((mx - rx) ** 2 + (my - ry) ** 2), 5) AS loss FROM c JOIN r USING (g)",
    "equilibrium_loss": f"WITH {_P}, s AS (SELECT sum(w) / (SELECT sum(w) FROM p) AS s FROM p GROUP BY g) SELECT round(sum(s * ln(s)), 6) AS loss FROM s",
    "qcfc_loss": """WITH e AS (SELECT user_id AS sid, event_type AS edge, avg(value) AS v FROM events GROUP BY 1, 2), q AS (SELECT user_id AS sid, count(*) AS q FROM events GROUP BY 1),
        r AS (SELECT edge, covar_pop(v, q) / ((stddev_pop(v) + 1e-8) * (stddev_pop(q) + 1e-8)) AS r FROM e JOIN q USING (sid) GROUP BY 1) SELECT round(avg(abs(r)), 6) AS loss, count(*) AS n FROM r""",
    "reliability_weighted": "SELECT round(sum(l_discount * abs(l_quantity - 25)) / (sum(abs(l_quantity - 25)) + 1e-8), 8) AS loss FROM lineitem",
}
