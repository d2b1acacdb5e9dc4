"""Pairwise second moments of channels observed on a shared time grid.

Channels meet in an equi-join on time, so the work grows with rows times channels; sums are taken
map-side before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.sources.series import DAILY, DAY, daily_channels, day_number
from axonframe.sources.tables import table


def pairs(left: DataFrame, right: DataFrame | None = None, on: str = "tr", *more: str) -> DataFrame:
    """(ch_i, ch_j, time, x, y): all channels of ``left`` against all of ``right`` (or itself) at each time."""
    right = left if right is None else right
    keep = [on, *more]
    return left.select(F.col("ch").alias("ch_i"), *keep, F.col("v").alias("x")).join(right.select(F.col("ch").alias("ch_j"), on, F.col("v").alias("y")), on)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson r, 0 where either side is constant (the diagonal included)."""
    return safe_ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def covariance(long: DataFrame, bias: bool = False, l2: float = 0.0) -> DataFrame:
    c = F.covar_pop("x", "y") if bias else F.covar_samp("x", "y")
    return pairs(long).groupBy("ch_i", "ch_j").agg((c + F.when(F.col("ch_i") == F.col("ch_j"), l2).otherwise(0.0)).alias("c"), F.count("*").alias("n"))


def correlation(long: DataFrame) -> DataFrame:
    return pairs(long).groupBy("ch_i", "ch_j").agg(guarded_corr("x", "y").alias("r"), F.count("*").alias("n"))


def weighted_moments(long: DataFrame) -> DataFrame:
    """(ch_i, ch_j, c, r) with observation weights ``w``: weights sum to 1, unbiased by 1 / (1 - sum w^2)."""
    w = F.col("w")
    sums = pairs(long, None, "tr", "w").groupBy("ch_i", "ch_j").agg(
        F.sum(w).alias("s"), F.sum(w * w).alias("s2"), F.sum(w * F.col("x")).alias("sx"), F.sum(w * F.col("y")).alias("sy"),
        F.sum(w * F.col("x") * F.col("y")).alias("sxy"), F.sum(w * F.col("x") ** 2).alias("sxx"), F.sum(w * F.col("y") ** 2).alias("syy"),
    )
    m = lambda ab, a, b: F.col(ab) / F.col("s") - F.col(a) * F.col(b) / F.col("s") ** 2
    c, vx, vy = m("sxy", "sx", "sy"), m("sxx", "sx", "sx"), m("syy", "sy", "sy")
    return sums.select("ch_i", "ch_j", (c / (1 - F.col("s2") / F.col("s") ** 2)).alias("c"), safe_ratio(c, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))).alias("r"))


def disattenuate(edges: DataFrame, reliability: DataFrame) -> DataFrame:
    """r / sqrt(rel_i rel_j), reliabilities clipped to [1e-8, 1], result to [-1, 1], diagonal 1."""
    rel = reliability.select(F.col("ch").alias("ch_i"), F.greatest(F.least("rel", F.lit(1.0)), F.lit(1e-8)).alias("ri"))
    both = edges.join(rel, "ch_i").join(rel.select(F.col("ch_i").alias("ch_j"), F.col("ri").alias("rj")), "ch_j")
    r = F.greatest(F.least(F.col("r") / F.sqrt(F.col("ri") * F.col("rj")), F.lit(1.0)), F.lit(-1.0))
    return both.select("ch_i", "ch_j", F.when(F.col("ch_i") == F.col("ch_j"), 1.0).otherwise(r).alias("r"))


def posterior_reliability(posterior: DataFrame) -> DataFrame:
    """var / (var + mean posterior variance) of (ch, tr, v, var), population variance."""
    return posterior.groupBy("ch").agg(safe_ratio(F.var_pop("v"), F.var_pop("v") + F.avg("var")).alias("rel"))


def phase_locking(phases: DataFrame) -> DataFrame:
    """|mean exp(i (phase_i - phase_j))| of every pair."""
    d = F.col("x") - F.col("y")
    return pairs(phases).groupBy("ch_i", "ch_j").agg(F.hypot(F.avg(F.cos(d)), F.avg(F.sin(d))).alias("plv"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return daily_channels(table(spark, d, "events"))


def _posterior(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("ch"), day_number().alias("tr")).agg(F.avg("value").alias("v"), (F.coalesce(F.var_samp("value"), F.lit(0.0)) / F.count("*")).alias("var"))


def fc_cov(spark: SparkSession, d: str) -> DataFrame:
    return covariance(_daily(spark, d)).select("ch_i", "ch_j", F.round("c", 6).alias("c"), "n")


def fc_corr(spark: SparkSession, d: str) -> DataFrame:
    return correlation(_daily(spark, d)).select("ch_i", "ch_j", F.round("r", 6).alias("r"), "n")


def fc_corr_weighted(spark: SparkSession, d: str) -> DataFrame:
    long = _daily(spark, d).withColumn("w", 1.0 + F.col("tr") % 3)
    return weighted_moments(long).select("ch_i", "ch_j", F.round("c", 6).alias("c"), F.round("r", 6).alias("r"))


def fc_attenuated(spark: SparkSession, d: str) -> DataFrame:
    long = _daily(spark, d)
    rel = long.groupBy("ch").agg((F.count("*") / (F.count("*") + 10.0)).alias("rel"))
    return disattenuate(correlation(long), rel).select("ch_i", "ch_j", F.round("r", 6).alias("r"))


def fc_posterior_corr(spark: SparkSession, d: str) -> DataFrame:
    long = _posterior(spark, d)
    return disattenuate(correlation(long), posterior_reliability(long)).select("ch_i", "ch_j", F.round("r", 6).alias("r"))


def cross_cov(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("ch"), day_number().alias("tr")).agg(F.count("*").cast("double").alias("v"))
    return pairs(_daily(spark, d), counts).groupBy("ch_i", "ch_j").agg(F.round(F.covar_samp("x", "y"), 6).alias("c"))


def plv(spark: SparkSession, d: str) -> DataFrame:
    phases = _daily(spark, d).withColumn("v", F.col("v") % (2 * math.pi))
    return phase_locking(phases).select("ch_i", "ch_j", F.round("plv", 6).alias("plv"))


_PAIRS = f"{DAILY}, pairs AS (SELECT a.ch AS ch_i, b.ch AS ch_j, a.tr, a.v AS x, b.v AS y FROM long a JOIN long b ON a.tr = b.tr)"
_R = "coalesce(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 0)"
_DIS = "round(CASE WHEN ch_i = ch_j THEN 1.0 ELSE greatest(least(r / sqrt(a.rel * b.rel), 1.0), -1.0) END, 6) AS r FROM e JOIN rel a ON a.ch = ch_i JOIN rel b ON b.ch = ch_j"

QUERIES = {f.__name__: f for f in (fc_cov, fc_corr, fc_corr_weighted, fc_attenuated, fc_posterior_corr, cross_cov, plv)}
ORACLES = {
    "fc_cov": f"WITH {_PAIRS} SELECT ch_i, ch_j, round(covar_samp(x, y), 6) AS c, count(*) AS n FROM pairs GROUP BY 1, 2",
    "fc_corr": f"WITH {_PAIRS} SELECT ch_i, ch_j, round({_R}, 6) AS r, count(*) AS n FROM pairs GROUP BY 1, 2",
    "fc_corr_weighted": f"""WITH {_PAIRS}, w AS (SELECT *, (1.0 + tr % 3) / sum(1.0 + tr % 3) OVER (PARTITION BY ch_i, ch_j) AS w FROM pairs),
        c AS (SELECT *, x - sum(w * x) OVER (PARTITION BY ch_i, ch_j) AS dx, y - sum(w * y) OVER (PARTITION BY ch_i, ch_j) AS dy FROM w)
        SELECT ch_i, ch_j, round(sum(w * dx * dy) / (1 - sum(w * w)), 6) AS c, round(sum(w * dx * dy) / sqrt(sum(w * dx * dx) * sum(w * dy * dy)), 6) AS r FROM c GROUP BY 1, 2""",
    "fc_attenuated": f"WITH {_PAIRS}, e AS (SELECT ch_i, ch_j, {_R} AS r FROM pairs GROUP BY 1, 2), rel AS (SELECT ch, count(*) / (count(*) + 10.0) AS rel FROM long GROUP BY 1) SELECT ch_i, ch_j, {_DIS}",
    "fc_posterior_corr": f"""WITH {_PAIRS}, e AS (SELECT ch_i, ch_j, {_R} AS r FROM pairs GROUP BY 1, 2),
        p AS (SELECT event_type AS ch, {DAY} AS tr, avg(value) AS v, coalesce(var_samp(value), 0) / count(*) AS vv FROM events GROUP BY 1, 2),
        rel AS (SELECT ch, greatest(least(var_pop(v) / (var_pop(v) + avg(vv)), 1), 1e-8) AS rel FROM p GROUP BY 1) SELECT ch_i, ch_j, {_DIS}""",
    "cross_cov": f"""WITH {DAILY}, c AS (SELECT event_type AS ch, {DAY} AS tr, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)
        SELECT a.ch AS ch_i, b.ch AS ch_j, round(covar_samp(a.v, b.v), 6) AS c FROM long a JOIN c b ON a.tr = b.tr GROUP BY 1, 2""",
    "plv": f"WITH {_PAIRS} SELECT ch_i, ch_j, round(sqrt(avg(cos(x % {2 * math.pi!r} - y % {2 * math.pi!r})) ** 2 + avg(sin(x % {2 * math.pi!r} - y % {2 * math.pi!r})) ** 2), 6) AS plv FROM pairs GROUP BY 1, 2",
}
