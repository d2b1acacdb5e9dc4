"""Complex series as two columns: conversions, z-scores, regression and signal-to-noise maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from axonframe.operators.regression import simple_fit
from axonframe.sources.series import SERIES, user_series
from axonframe.sources.tables import table


def from_mag_phase(magnitude: Column, phase: Column) -> tuple[Column, Column]:
    return magnitude * F.cos(phase), magnitude * F.sin(phase)


def to_mag_phase(re: Column, im: Column) -> tuple[Column, Column]:
    return F.hypot(re, im), F.atan2(im, re)


def zscore_complex(rows: DataFrame, key: str) -> DataFrame:
    """Real and imaginary parts by series, each by its own mean and population deviation + 1e-8."""
    own = W.partitionBy(key)
    return rows.withColumns({c: (F.col(c) - F.avg(c).over(own)) / (F.stddev_pop(c).over(own) + 1e-8) for c in ("re", "im")})


def complex_fit(rows: DataFrame, key: str, x: str) -> DataFrame:
    """(key, n, re, im, var): the complex slope on a real regressor, and the variance of each of its parts from both residuals."""
    a, b = (simple_fit(rows, [key], F.col(x), F.col(c)).select(key, "n", F.col("slope").alias(c), F.col("sigma2").alias(f"s_{c}")) for c in ("re", "im"))
    spread = rows.groupBy(key).agg((F.var_pop(x) * F.count("*")).alias("sxx"))
    both = a.join(b.drop("n"), key).join(spread, key).filter("n > 2 AND sxx > 0")
    return both.select(key, "n", "re", "im", ((F.col("s_re") + F.col("s_im")) / 2 / F.col("sxx")).alias("var"))


def snr(fit: DataFrame) -> DataFrame:
    return fit.withColumn("snr", (F.col("re") ** 2 + F.col("im") ** 2) / (F.col("var") + 1e-10))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Values as magnitudes, event ids as phases."""
    s = user_series(table(spark, d, "events"))
    re, im = from_mag_phase(F.col("v"), F.col("event_id") % 7 / 7.0)
    return s.select("sid", "t", re.alias("re"), im.alias("im"))


def polar_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m, p = to_mag_phase(F.col("re"), F.col("im"))
    return _rows(spark, d).select("sid", "t", *(F.round(c, 6).alias(n) for n, c in (("re", F.col("re")), ("im", F.col("im")), ("magnitude", m), ("phase", p))))


def complex_zscore(spark: SparkSession, d: str) -> DataFrame:
    return zscore_complex(_rows(spark, d), "sid").select("sid", "t", F.round("re", 5).alias("re"), F.round("im", 5).alias("im"))


def complex_glm(spark: SparkSession, d: str) -> DataFrame:
    return complex_fit(_rows(spark, d), "sid", "t").select("sid", "n", *(F.round(c, 6).alias(c) for c in ("re", "im")), F.round("var", 7).alias("var"))


def complex_snr_map(spark: SparkSession, d: str) -> DataFrame:
    return snr(complex_fit(_rows(spark, d), "sid", "t")).select("sid", F.round("snr", 4).alias("snr"))


_C = f"{SERIES}, c AS (SELECT sid, t, v, v * cos(event_id % 7 / 7.0) AS re, v * sin(event_id % 7 / 7.0) AS im FROM s)"
_G = f"""{_C}, g AS (SELECT sid, count(*) AS n, regr_slope(re, t) AS re, regr_slope(im, t) AS im,
    ((regr_syy(re, t) - regr_sxy(re, t) ** 2 / regr_sxx(re, t)) + (regr_syy(im, t) - regr_sxy(im, t) ** 2 / regr_sxx(im, t))) / (count(*) - 2) / 2 / regr_sxx(re, t) AS var FROM c GROUP BY 1 HAVING count(*) > 2)"""
QUERIES = {f.__name__: f for f in (polar_round_trip, complex_zscore, complex_glm, complex_snr_map)}
ORACLES = {
    "polar_round_trip": f"WITH {_C} SELECT sid, t, round(re, 6) AS re, round(im, 6) AS im, round(sqrt(re * re + im * im), 6) AS magnitude, round(atan2(im, re), 6) AS phase FROM c",
    "complex_zscore": f"WITH {_C} SELECT sid, t, round((re - avg(re) OVER w) / (stddev_pop(re) OVER w + 1e-8), 5) AS re, round((im - avg(im) OVER w) / (stddev_pop(im) OVER w + 1e-8), 5) AS im FROM c WINDOW w AS (PARTITION BY sid)",
    "complex_glm": f"WITH {_G} SELECT sid, n, round(re, 6) AS re, round(im, 6) AS im, round(var, 7) AS var FROM g",
    "complex_snr_map": f"WITH {_G} SELECT sid, round((re * re + im * im) / (var + 1e-10), 4) AS snr FROM g",
}
