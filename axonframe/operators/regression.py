"""Regressions whose normal equations are a handful of sums: everything here is one aggregate and an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.sources.series import SERIES, user_series
from axonframe.sources.tables import table


def simple_fit(rows: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """slope, intercept, r2, residual variance, t of the slope and n of y on x by ``keys``; constant x gives slope 0."""
    sums = rows.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.covar_pop("x", "y") * F.count("*")).alias("sxy"),
        (F.var_pop("x") * F.count("*")).alias("sxx"), (F.var_pop("y") * F.count("*")).alias("syy"),
    )
    slope = F.coalesce(F.col("sxy") / F.nullif("sxx", F.lit(0.0)), F.lit(0.0))
    fit = sums.withColumn("slope", slope).withColumn("rss", F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)))
    sigma2 = F.when(F.col("n") > 2, F.col("rss") / (F.col("n") - 2))
    return fit.select(
        *keys, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), (1 - F.col("rss") / (F.col("syy") + 1e-12)).alias("r2"),
        sigma2.alias("sigma2"), F.coalesce(F.col("slope") / F.nullif(F.sqrt(sigma2 / F.nullif("sxx", F.lit(0.0))), F.lit(0.0)), F.lit(0.0)).alias("tstat"),
    )


def residuals(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``rows`` with ``residual``; the fits, one row per key, are joined back."""
    fit = simple_fit(rows, keys, F.col(x), F.col(y)).select(*keys, "slope", "intercept")
    return rows.join(fit, keys).withColumn("residual", F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x))).drop("slope", "intercept")


def shrink(mean: Column, var: Column, prior_mean: Column, prior_var: Column) -> tuple[Column, Column]:
    """Precision-weighted mean and its variance."""
    p = 1 / var + 1 / prior_var
    return (mean / var + prior_mean / prior_var) / p, 1 / p


def conjugate_mean(rows: DataFrame, key: str, y: str, precision: float = 0.01, a0: float = 0.01, b0: float = 0.01) -> DataFrame:
    """Normal-inverse-gamma posterior of a mean: posterior mean, sigma2 = max(b / (a - 1), 1e-10) and variance."""
    s = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"))
    mean = F.col("s") / (F.col("n") + precision)
    b = b0 + 0.5 * (F.col("ss") - mean * mean * (F.col("n") + precision))
    sigma2 = F.greatest(b / (a0 + F.col("n") / 2 - 1), F.lit(1e-10))
    return s.select(key, "n", mean.alias("mean"), sigma2.alias("sigma2"), (sigma2 / (F.col("n") + precision)).alias("var"))


def _fit(spark: SparkSession, d: str) -> DataFrame:
    return simple_fit(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice"))


def ols_simple(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d).select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in ("slope", "intercept", "r2")))


def ols_tstat(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d).select("l_returnflag", F.round("tstat", 4).alias("tstat"), (F.col("n") - 2).alias("df"))


def ols_residuals(spark: SparkSession, d: str) -> DataFrame:
    rows = residuals(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", F.round("residual", 3).alias("residual"))


def r2_by_series(spark: SparkSession, d: str) -> DataFrame:
    return simple_fit(user_series(table(spark, d, "events")), ["sid"], F.col("t"), F.col("v")).select("sid", "n", F.round("r2", 6).alias("r2"))


def gaussian_shrink(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("sid")).agg(F.avg("value").alias("m"), (F.var_samp("value") / F.count("*")).alias("v")).filter("v > 0")
    prior = users.agg(F.avg("m").alias("pm"), F.var_pop("m").alias("pv")).first()
    if prior["pv"] is None or prior["pv"] <= 0:
        return users.select("sid", F.round("m", 6).alias("mean"), F.round("v", 6).alias("var"))
    mean, var = shrink(F.col("m"), F.col("v"), F.lit(prior["pm"]), F.lit(prior["pv"]))
    return users.select("sid", F.round(mean, 6).alias("mean"), F.round(var, 6).alias("var"))


def conjugate_mean_only(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("sid"), "value")
    return conjugate_mean(rows, "sid", "value").select("sid", "n", *(F.round(c, 5).alias(c) for c in ("mean", "sigma2", "var")))


def phase_residuals(spark: SparkSession, d: str) -> DataFrame:
    rows = user_series(table(spark, d, "events")).withColumn("phase", F.cos(F.col("event_id").cast("double")))
    return residuals(rows, ["sid"], "phase", "v").select("sid", "t", F.round("residual", 5).alias("residual"))


QUERIES = {f.__name__: f for f in (ols_simple, ols_tstat, ols_residuals, r2_by_series, gaussian_shrink, conjugate_mean_only, phase_residuals)}
ORACLES = {
    "ols_simple": "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem GROUP BY 1",
    "ols_tstat": """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity) / sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2
        / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 4) AS tstat, count(*) - 2 AS df FROM lineitem GROUP BY 1""",
    "ols_residuals": """WITH f AS (SELECT l_returnflag AS k, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1)
        SELECT l_orderkey, l_linenumber, round(l_extendedprice - (a + b * l_quantity), 3) AS residual FROM lineitem JOIN f ON k = l_returnflag""",
    "r2_by_series": f"WITH {SERIES} SELECT sid, count(*) AS n, round(regr_r2(v, t), 6) AS r2 FROM s GROUP BY 1",
    "gaussian_shrink": """WITH u AS (SELECT user_id AS sid, avg(value) AS m, var_samp(value) / count(*) AS v FROM events GROUP BY 1 HAVING var_samp(value) > 0), p AS (SELECT avg(m) AS pm, var_pop(m) AS pv FROM u)
        SELECT sid, round((m / v + pm / pv) / (1 / v + 1 / pv), 6) AS mean, round(1 / (1 / v + 1 / pv), 6) AS var FROM u, p""",
    "conjugate_mean_only": """WITH a AS (SELECT user_id AS sid, count(*) AS n, sum(value) / (count(*) + 0.01) AS mean, sum(value * value) AS ss FROM events GROUP BY 1),
        b AS (SELECT *, greatest((0.01 + 0.5 * (ss - mean * mean * (n + 0.01))) / (0.01 + n / 2.0 - 1), 1e-10) AS s2 FROM a)
        SELECT sid, n, round(mean, 5) AS mean, round(s2, 5) AS sigma2, round(s2 / (n + 0.01), 5) AS var FROM b""",
    "phase_residuals": f"""WITH {SERIES}, f AS (SELECT sid AS k, regr_slope(v, cos(event_id)) AS b, regr_intercept(v, cos(event_id)) AS a FROM s GROUP BY 1)
        SELECT sid, t, round(v - (a + b * cos(event_id)), 5) AS residual FROM s JOIN f ON k = sid""",
}
